"""Tokenizers and token tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.config import Parameters

OTHER = r"[^\p{L}\p{N}_]+"  # runs of characters that are in no token


def splitter(body: Column, delimiter: str = ",") -> Column:
    """Upper-case tokens between runs of non-word characters."""
    return F.filter(F.split(F.regexp_replace(F.upper(body), OTHER, " "), " "), lambda x: F.length(x) > 0)


def compress(body: Column, delimiter: str = ",") -> Column:
    """Upper-case tokens between delimiters and white space, non-word characters deleted inside them."""
    parts = F.split(F.replace(F.upper(body), F.lit(delimiter), F.lit(" ")), r"\s+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, OTHER, "")), lambda x: F.length(x) > 0)


TOKENIZERS = {"Splitter": splitter, "Compress": compress}


def tokenize(body: Column, p: Parameters) -> Column:
    if p.tokenizerType not in TOKENIZERS:
        raise ValueError(f"no tokenizer {p.tokenizerType!r}")
    return TOKENIZERS[p.tokenizerType](body, p.separator)


def is_numeric(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def blocks(token: Column, freq: Column, p: Parameters) -> Column:
    """A token that may name a block."""
    ok = freq.between(2, p.beta) & (F.length(token) >= p.minBlkTokenLen)
    return ok & ~is_numeric(token) if p.excludeNumericBlocks else ok


def scoring_tokens(toks: Column, p: Parameters) -> Column:
    """Tokens of a reference (array of structs with tok and freq) that are compared: stop words and the like are out."""

    def stays(x: Column) -> Column:
        ok = x["freq"] < p.sigma
        if p.removeExcludedBlkTokens:
            ok = ok & (F.length(x["tok"]) >= p.minBlkTokenLen)
            if p.excludeNumericBlocks:
                ok = ok & ~is_numeric(x["tok"])
        return ok

    out = F.transform(F.filter(toks, stays), lambda x: x["tok"])
    return F.array_distinct(out) if p.removeDuplicateTokens else out
