"""Text and JSON functions as column expressions; Python only where nothing built in can do it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The shape of an extraction record.
RECORD = T.StructType([
    T.StructField("attributes", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("triples", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("entity_types", T.MapType(T.StringType(), T.StringType())),
])


def clean_text(text: Column) -> Column:
    """Letters, digits, white space and common punctuation only; markers for empty input and output."""
    kept = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}\s.:,!?()\-+=]", ""))
    return F.when(text.isNull() | (F.trim(text) == ""), "[EMPTY_TEXT]").when(kept == "", "[EMPTY_AFTER_CLEANING]").otherwise(kept)


def token_count(text: Column) -> Column:
    """Tokens, approximated by white-space separated words (no vocabulary is needed); 0 without any, null for null."""
    return F.when(F.trim(text) == "", 0).when(text.isNotNull(), F.size(F.split(F.trim(text), r"\s+")))


def clean_reply(reply: Column) -> Column:
    """A model's reply with plain newlines, without zero-width characters, code fences and a leading ``json`` line."""
    plain = F.regexp_replace(F.regexp_replace(reply, r"\r\n?", "\n"), "[\\u200B-\\u200D\\uFEFF]", "")
    inner = F.regexp_extract(plain, r"(?s)```[A-Za-z]*\n?(.*?)```", 1)
    body = F.when(inner != "", inner).otherwise(plain)
    white = F.lit(" \n\t")
    return F.btrim(F.regexp_replace(F.btrim(body, white), r"^json\s*\n", ""), white)


def stringify(value: Column) -> Column:
    """A map as ``key: value`` pairs in order of key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")


def nodes_hash(ids: Column) -> Column:
    """The first 16 hex digits of the md5 of the sorted ids."""
    return F.substring(F.md5(F.array_join(F.array_sort(ids), "|")), 1, 16)


def short_id(text: Column, salt: Column | str = "") -> Column:
    """An id made from content, the same at every run: 128 bits, so that no two of 10^12 texts share one."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt) if isinstance(salt, str) else salt, text), 256), 1, 32)


def _repaired(text: str | None) -> str | None:
    """JSON of an object from a reply that may be cut off or padded; ``{}`` if there is none."""
    if text is None:
        return "{}"
    at = text.find("{")
    if at < 0:
        return "{}"
    body = text[at:]
    try:
        found, _ = json.JSONDecoder().raw_decode(body)
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else "{}"
    except ValueError as wrong:
        at = getattr(wrong, "pos", len(body))
    closers, quoted, skip, good = [], False, False, []
    for i, c in enumerate(body):
        if quoted:
            quoted, skip = (c != '"' or skip), (c == "\\" and not skip)
        elif c == '"':
            quoted, skip = True, False
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]" and closers:
            closers.pop()
        if not quoted and c in '}],"':
            good.append((i if c == "," else i + 1, "".join(reversed(closers))))
    # near the end first; a fault far before it leaves what stands before the fault, which is valid
    for end, tail in chain(reversed(good[-200:]), reversed([g for g in good[:-200] if g[0] <= at])):
        try:
            found = json.loads(body[:end] + tail)
        except ValueError:
            continue
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else "{}"
    return "{}"


@F.pandas_udf(T.StringType())
def repair_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Replies as valid JSON objects: cut-off ones are closed after their last whole part."""
    for s in texts:
        yield s.map(_repaired)


def parse_record(reply: Column, repair: bool = True) -> Column:
    """The extraction record of a reply; what cannot be read is an empty record."""
    text = clean_reply(reply)
    return F.from_json(repair_json(text) if repair else text, RECORD)


def plain(value: object) -> object:
    """A value that JSON can hold: arrays, sets and scalars of numeric libraries as lists and numbers, anything unknown as its text."""
    if isinstance(value, dict):
        return {k if isinstance(k := plain(key), (str, int, float, bool)) or k is None else str(k): plain(v) for key, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v) for v in value), key=repr)
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        return value.item()
    return value if value is None or isinstance(value, (str, bool, int, float)) else str(value)
