"""Run parameters: a frozen record, its ``name=value`` file form and its checks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace
from decimal import Decimal, InvalidOperation

# The accepted parameter names, the delimiters, the comparators and the tokenizers.
DELIMITERS = (",", ";", ":", "|", "TAB")
COMPARATORS = ("ScoringMatrixStd", "ScoringMatrixKris", "Cosine", "MongeElkan")
TOKENIZERS = ("Splitter", "Compress")
UNUSED = (
    "runGlobalCorrection", "globalCorrectionDetail", "minFreqStdToken", "minLenStdToken", "maxFreqErrToken",
    "blockCorrection", "blockCorrectionDetail", "runClusterMetrics", "createFinalJoin",
)


@dataclass(frozen=True)
class Parameters:
    """One field for each accepted name; field types drive the parsing."""

    inputFileName: str = ""
    delimiter: str = ","
    hasHeader: bool = False
    tokenizerType: str = "Splitter"
    truthFileName: str = ""
    beta: int = 2
    blockByPairs: bool = True
    minBlkTokenLen: int = 4
    excludeNumericBlocks: bool = True
    sigma: int = 12
    removeDuplicateTokens: bool = False
    removeExcludedBlkTokens: bool = True
    mu: Decimal = Decimal("0.50")
    muIterate: Decimal = Decimal("0.10")
    epsilon: Decimal = Decimal("0.50")
    epsilonIterate: Decimal = Decimal("0.00")
    comparator: str = "ScoringMatrixStd"
    matrixNumTokenRule: bool = False
    matrixInitialRule: bool = False
    runIterationProfile: bool = False
    addRefsToLinkIndex: bool = False
    runGlobalCorrection: bool = False
    globalCorrectionDetail: bool = False
    minFreqStdToken: int = 5
    minLenStdToken: int = 3
    maxFreqErrToken: int = 3
    blockCorrection: bool = False
    blockCorrectionDetail: bool = False
    runClusterMetrics: bool = False
    createFinalJoin: bool = False

    @property
    def separator(self) -> str:
        return "\t" if self.delimiter == "TAB" else self.delimiter

    def checked(self) -> Parameters:
        """These parameters, or ``ValueError`` with every rule they break."""
        wrong = []
        rule = lambda ok, text: None if ok else wrong.append(text)
        rule(self.delimiter in DELIMITERS, f"delimiter must be one of {' '.join(DELIMITERS)}")
        rule(self.tokenizerType in TOKENIZERS, f"tokenizerType must be one of {' '.join(TOKENIZERS)}")
        rule(self.comparator in COMPARATORS, f"comparator must be one of {' '.join(COMPARATORS)}")
        rule(self.beta >= 2, "beta must be 2 or more")
        rule(self.sigma > self.beta, "sigma must be greater than beta")
        for name in ("mu", "epsilon"):
            rule(0 < getattr(self, name) <= 1, f"{name} must be above 0 and 1 at most")
        for name in ("muIterate", "epsilonIterate"):
            rule(0 <= getattr(self, name) <= 1, f"{name} must be from 0 to 1")
        rule(self.minFreqStdToken > self.maxFreqErrToken, "minFreqStdToken must be greater than maxFreqErrToken")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


_KINDS = {f.name: f.type for f in fields(Parameters)}


def _value(name: str, text: str) -> object:
    kind = _KINDS[name]
    if kind == "bool":
        if text not in ("True", "False"):
            raise ValueError(f"{name} must be True or False, not {text!r}")
        return text == "True"
    if kind == "int":
        if not text.isdigit():
            raise ValueError(f"{name} must be a whole number, not {text!r}")
        return int(text)
    if kind == "Decimal":
        try:
            return Decimal(text)
        except InvalidOperation:
            raise ValueError(f"{name} must be a number, not {text!r}") from None
    return text


def parse_parameters(text: str) -> Parameters:
    """Parameters from ``name=value`` lines; ``#`` opens a comment line, the first blank line ends the file."""
    given: dict[str, object] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line:
            break
        if line.startswith("#"):
            continue
        name, sign, value = (x.strip() for x in line.partition("="))
        if not sign:
            raise ValueError(f"no '=' in {line!r}")
        if name not in _KINDS:
            raise ValueError(f"unknown parameter {name!r}")
        given[name] = _value(name, value)
    idle = [n for n in UNUSED if given.get(n)]
    if any(isinstance(given[n], bool) for n in idle):
        warnings.warn(f"accepted without effect: {', '.join(n for n in idle if isinstance(given[n], bool))}", stacklevel=2)
    return replace(Parameters(), **given).checked()


def read_parameters(path: str) -> Parameters:
    with open(path, encoding="utf-8") as f:
        return parse_parameters(f.read())


def summary(p: Parameters) -> list[tuple[str, str]]:
    """(name, value) of every parameter, as text."""
    return [(f.name, str(getattr(p, f.name))) for f in fields(p)]
