"""Parameters of an analysis, with their public names and defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # input
    minMappingQualityQ1: int = 20
    minReadMedianPhredScore: int = 0
    minInsertSize: int = 0
    maxInsertSize: int = 1000
    ignoreSizeOutOfRangeInserts: bool = False
    ignoreTandemRFPairs: bool = False
    ignoreZeroInsertSizeReads: bool = False
    dropReadProbability: float = 0.0
    nRecordsToProcess: int = 9_223_372_036_854_775_807
    contigExcludePattern: str = "decoy,_alt,_random,HLA-,chrUn_"
    # barcodes and grouping
    variableBarcodeLength: int = 3
    constantBarcode: str = "TCT"
    nVariableBarcodeMismatchesAllowed: int = 1
    nConstantBarcodeMismatchesAllowed: int = 3
    alignmentPositionMismatchAllowed: int = 0
    requireMatchInAlignmentEnd: bool = False
    acceptNInBarCode: bool = True
    # bases
    minBasePhredScoreQ1: int = 20
    minBasePhredScoreQ2: int = 30
    ignoreFirstNBasesQ1: int = 4
    ignoreFirstNBasesQ2: int = 35
    ignoreLastNBases: int = 4
    # molecules
    minMappingQualityQ2: int = 50
    minReadsPerStrandQ1: int = 0
    minReadsPerStrandQ2: int = 3
    minReadsPerDuplexQ2: int = 3
    minConsensusThresholdQ1: float = 0.51
    minConsensusThresholdQ2: float = 0.95
    maxAverageBasesClipped: int = 15
    # positions
    minMedianPhredScoreAtPosition: int = 0
    minCandidateMedianPhredScore: int = 20
    maxFractionWrongPairsAtPosition: float = 1.0
    maxAverageClippingOfAllCoveringDuplexes: int = 999
    minTopAlleleFreqQ2: float = 0.0
    maxTopAlleleFreqQ2: float = 1.0
    topAlleleFreqReport: float = 0.3
    # calls
    minQ2DuplexesToCallMutation: int = 1
    minQ1Q2DuplexesToCallMutation: int = 1
    minNumberDuplexesSisterSamples: int = 10
    maxNDuplexes: int = 2_147_483_647
    Q2DisagCapsMatchingMutationQuality: bool = True
    maxMutFreqForDisag: float = 1.0
    minReadsPerStrandForDisagreement: int = 0
    minConcurringDuplexReads: int = 2
    # reports and options
    contigStatsBinLength: int = 2_000_000
    processingChunk: int = 160
    filterOpticalDuplicates: bool = False
    opticalDuplicateDistance: int = 100

    def validated(self) -> Params:
        """These parameters, or a ValueError that names the first bad one."""
        for low, high in (("minInsertSize", "maxInsertSize"), ("minConsensusThresholdQ1", "minConsensusThresholdQ2"), ("minTopAlleleFreqQ2", "maxTopAlleleFreqQ2")):
            if getattr(self, low) > getattr(self, high):
                raise ValueError(f"{low} is above {high}")
        for name in ("dropReadProbability", "minConsensusThresholdQ1", "minConsensusThresholdQ2", "maxFractionWrongPairsAtPosition"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is not between 0 and 1")
        return self

    @classmethod
    def parse(cls, arguments: list[str]) -> Params:
        """From command-line words: `-name value`, or `-name` alone for a flag."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        given: dict = {}
        words = list(arguments)
        while words:
            name = words.pop(0).lstrip("-")
            if name not in kinds:
                raise ValueError(f"unknown parameter {name}")
            if kinds[name] is bool and (not words or words[0].startswith("-")):
                given[name] = True
            else:
                value = words.pop(0)
                given[name] = value.lower() == "true" if kinds[name] is bool else kinds[name](value)
        return replace(cls(), **given).validated()

    def changed(self) -> list[tuple[str, str]]:
        """(name, value) of what differs from the defaults, in order of names."""
        return sorted((f.name, str(getattr(self, f.name))) for f in fields(self) if getattr(self, f.name) != f.default)

    def sweep(self, name: str, low: float, high: float, steps: int = 10) -> list[Params]:
        """Copies with `name` at evenly spaced values, both ends included."""
        kind = type(getattr(self, name))
        return [replace(self, **{name: kind(low + (high - low) * k / max(steps - 1, 1))}) for k in range(steps)]
