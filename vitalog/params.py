"""Search parameters and the known type names."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

# The type names users ask for most; any other text is accepted as well.
RECORD_TYPES = (
    "HKQuantityTypeIdentifierStepCount",
    "HKQuantityTypeIdentifierBodyMassIndex",
    "HKQuantityTypeIdentifierHeartRate",
    "HKQuantityTypeIdentifierBodyMass",
    "HKQuantityTypeIdentifierHeight",
    "HKQuantityTypeIdentifierDietaryWater",
    "HKQuantityTypeIdentifierActiveEnergyBurned",
    "HKQuantityTypeIdentifierBasalEnergyBurned",
    "HKQuantityTypeIdentifierDistanceWalkingRunning",
    "HKQuantityTypeIdentifierRunningSpeed",
    "HKQuantityTypeIdentifierRunningPower",
    "HKQuantityTypeIdentifierAppleExerciseTime",
    "HKQuantityTypeIdentifierAppleStandTime",
    "HKQuantityTypeIdentifierFlightsClimbed",
    "HKQuantityTypeIdentifierWalkingStepLength",
    "HKQuantityTypeIdentifierWalkingSpeed",
    "HKQuantityTypeIdentifierEnvironmentalAudioExposure",
)
WORKOUT_TYPES = (
    "HKWorkoutActivityTypeRunning",
    "HKWorkoutActivityTypeWalking",
    "HKWorkoutActivityTypeHiking",
    "HKWorkoutActivityTypeTraditionalStrengthTraining",
    "HKWorkoutActivityTypeCycling",
    "HKWorkoutActivityTypeMixedMetabolicCardioTraining",
    "HKWorkoutActivityTypeHighIntensityIntervalTraining",
    "HKWorkoutActivityTypeHockey",
)
INTERVALS = ("day", "week", "month", "year")
WORKOUT_PREFIX = "HKWorkout"
DEFAULT_LIMIT = 10


def is_workout(record_type: str | None) -> bool:
    """Workout types are told apart from record types by their name prefix."""
    return bool(record_type) and record_type.startswith(WORKOUT_PREFIX)


def check_interval(interval: str) -> str:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {', '.join(INTERVALS)}, not {interval!r}")
    return interval


def parse_instant(text: str | datetime | None) -> datetime | None:
    """ISO 8601 text to an aware UTC instant; text without an offset is taken as UTC."""
    if text is None or text == "":
        return None
    at = text if isinstance(text, datetime) else datetime.fromisoformat(text.strip())
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def parse_number(text: str | float | int | None) -> float | None:
    """A numeric bound; text that is no number is an error, as it is in SQL."""
    if text is None or text == "":
        return None
    return float(text)


@dataclass(frozen=True)
class SearchParams:
    """Optional search bounds; empty text means "not given". All ranges are inclusive."""

    record_type: str | None = None
    source_name: str | None = None
    date_from: str | datetime | None = None
    date_to: str | datetime | None = None
    min_workout_duration: str | float | None = None
    max_workout_duration: str | float | None = None
    value_min: str | float | None = None
    value_max: str | float | None = None
    limit: int = DEFAULT_LIMIT

    @property
    def wants_workouts(self) -> bool:
        return is_workout(self.record_type)
