"""Text functions that Spark lacks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts that are Python's own strings at a time.
SLICE = 256


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    slices = (texts.slice(i, SLICE).to_pylist() for i in range(0, len(texts), SLICE))
    done = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in s], pa.string()) for s in slices]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility normal form; only texts with characters beyond ASCII go through Python."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, text).otherwise(_nfkc(F.when(~plain, text)))


#: White space of the texts' own protocol, inside a character class: the Unicode spaces, line separators and the byte order mark.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACES}]+|[{SPACES}]+\z", "")


def normalised(text: Column) -> Column:
    """Null as empty, compatibility normal form, line ends as \\n, no outer white space."""
    return trimmed(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"\r\n?", "\n"))


def once(value: Column, f) -> Column:
    """f(value) with value computed a single time, however often f reads it: the variable of a lambda over one element."""
    return F.get(F.transform(F.array(value), f), 0)


def name_key(text: Column) -> Column:
    """A file or label name for matching: normal form, without the page sign, spaces, underscores and dashes, in lower case."""
    return F.lower(F.regexp_replace(nfkc(F.replace(F.coalesce(text, F.lit("")), F.lit("📄"), F.lit(""))), r"(?U)[\s_\-—–]+", ""))
