"""Study configuration: year bounds, cohort windows and parameter sweeps."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

# They decide results and have to stay as they are.
FIRST_EVIDENCE_YEAR = 1990
LAST_EVIDENCE_YEAR = 2024
DEFAULT_LAST_TRAINING_YEAR = 2015
DEFAULT_WINDOW = 2
DEFAULT_PHASE = 2
PRESENT_DAY_YEARS_SINCE_TRANSITION = 5


@dataclass(frozen=True)
class YearBounds:
    """Years outside ``first..last`` collapse onto the year just beyond the bound."""

    first: int = FIRST_EVIDENCE_YEAR
    last: int = LAST_EVIDENCE_YEAR


@dataclass(frozen=True)
class CohortSpec:
    """Which transitions enter a cohort and by when they must have advanced."""

    phase: int
    min_transition_year: int
    max_transition_year: int
    max_advancement_year: int | None


@dataclass(frozen=True)
class StudyConfig:
    """One study; the training and evaluation cohorts follow from it."""

    version: str
    last_training_year: int = DEFAULT_LAST_TRAINING_YEAR
    window: int = DEFAULT_WINDOW
    phase: int = DEFAULT_PHASE
    bounds: YearBounds = YearBounds()
    validate: bool = True

    @property
    def training(self) -> CohortSpec:
        return CohortSpec(
            phase=self.phase,
            min_transition_year=self.bounds.first,
            max_transition_year=self.last_training_year,
            max_advancement_year=self.last_training_year + self.window,
        )

    @property
    def evaluation(self) -> CohortSpec:
        return CohortSpec(
            phase=self.phase,
            min_transition_year=self.last_training_year + 1,
            max_transition_year=self.bounds.last - self.window,
            max_advancement_year=self.bounds.last,
        )


def sweep_configs(
    versions: list[str],
    centre_year: int = DEFAULT_LAST_TRAINING_YEAR,
    year_steps: tuple[int, ...] = (-2, 0, 2),
    windows: tuple[int, ...] = (2, 4),
    phase: int = DEFAULT_PHASE,
    bounds: YearBounds = YearBounds(),
) -> list[StudyConfig]:
    """Every combination of version, last training year and window."""
    return [
        StudyConfig(version, centre_year + step, window, phase, bounds)
        for version, step, window in product(sorted(versions), year_steps, windows)
    ]
