"""UDF1. What every specialist offers, and the two that are built in."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import change as CH
from ..operators import fusion as U


@dataclass(frozen=True)
class Capability:
    name: str
    task: str
    modalities: tuple[str, ...]
    inputs: tuple[int, ...]


class Specialist(ABC):
    """A specialist takes a table of inputs and gives a table of results. A model's weights are loaded in the workers, once
    for each (see runtime.shared); load and cleanup are for what the driver holds."""

    capability: Capability

    def __init__(self) -> None:
        self._loaded = False

    @property
    def is_loaded(self) -> bool:
        return self._loaded

    def load(self) -> None:
        self._loaded = True

    def cleanup(self) -> None:
        self._loaded = False

    def health_check(self) -> bool:
        return True

    @abstractmethod
    def predict(self, inputs: DataFrame) -> DataFrame:
        """The results of the inputs."""

    def __call__(self, inputs: DataFrame) -> DataFrame:
        """predict, loaded first if need be: a Registry's pipeline."""
        if not self._loaded:
            self.load()
        return self.predict(inputs)


class ChangeDetector(Specialist):
    """CMP3 over scene, y, x, a, b: the zonal statistics of every scene."""

    capability = Capability("CHANGE_DETECT", "change_detection", ("optical", "multispectral", "sar"), (2,))

    def __init__(self, height: int, width: int):
        super().__init__()
        self.height, self.width = height, width

    def predict(self, inputs: DataFrame) -> DataFrame:
        return CH.detect(inputs, self.height, self.width)["zonal"]


class SensorFusion(Specialist):
    """CMP4 over scene, y, x, r, g, b, sar: the shares of classes of every scene."""

    capability = Capability("OPTICAL_SAR_FUSION", "optical_sar_analysis", ("optical", "sar"), (2,))

    def __init__(self, height: int, width: int):
        super().__init__()
        self.height, self.width = height, width

    def predict(self, inputs: DataFrame) -> DataFrame:
        return U.histogram(U.classes(inputs, self.height, self.width))
