"""Which names stand in which texts: one Aho-Corasick automaton for few names, a join on the pieces of the texts for many.

A name is found wherever ``contains(lower(text), lower(name))`` holds.  Names of up to
``ONE_AUTOMATON`` bytes in all are one automaton, which every task builds from a broadcast
list.  More are a table: each piece of a text that has the length of some name and passes a filter of bounded
size goes to the names that are equal to it.  The work grows with the texts' characters times the names' different lengths, not with texts times names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names in an automaton (it takes some forty times that in memory).
ONE_AUTOMATON = 1 << 20
#: The filter has so many bits for a name, as a power of two within these bounds (32 MB at most); with more names it only lets more through.
BITS, LEAST_LOG, MOST_LOG = 16, 16, 28
#: Bits of the filter that stand together; parts that a name's finds are dealt to.
SPAN_LOG, SALTS = 16, 8
#: Characters of texts that are looked through at a time.
CHARACTERS = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


@lru_cache(maxsize=2)
def _automaton(names: tuple[str, ...]):
    """An automaton over names in lower case; a find tells the places of all names with that form."""
    import ahocorasick

    made, forms = ahocorasick.Automaton(), {}
    for i, n in enumerate(names):
        forms.setdefault(n.lower(), []).append(i)
    for form, places in forms.items():
        made.add_word(form, (len(form), places))
    made.make_automaton()
    return made


def found_in(text: str | None, names: tuple[str, ...]) -> list[tuple[int, str]]:
    """(first place, name) of each name in a text, in order."""
    if not text or not names:
        return []
    first: dict[int, int] = {}
    low = text.lower()
    for end, (size, places) in _automaton(names).iter(low):
        for i in places:
            first.setdefault(i, end - size + 1)
    return sorted((at, names[i]) for i, at in first.items())


def find_names(texts: DataFrame, names: DataFrame, key: str, text_col: str = "text", name_col: str = "name", automaton_bytes: int = ONE_AUTOMATON) -> DataFrame:
    """(key, at, name): each different name that stands in each text and where it first does (from 0, in characters of the text in lower case).

    Empty and null names and texts are in no find."""
    wanted = names.select(F.col(name_col).alias("name")).filter("name is not null and name <> ''").distinct()
    size = wanted.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    shape = f"{key} {kind}, at int, name string"

    def told(keys, texts_, lists):
        row, at, said = [], [], []
        for i, (text, known) in enumerate(zip(texts_, lists, strict=True)):
            for place, name in found_in(text, known):
                row.append(i)
                at.append(place)
                said.append(name)
        return pa.record_batch([keys.take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(said, pa.string())], names=[key, "at", "name"])

    if size <= automaton_bytes:
        known = tuple(sorted(r["name"] for r in wanted.collect()))  # checked: at most ``automaton_bytes``

        def run(batches):
            for batch in batches:
                yield told(batch.column(0), batch.column(1).to_pylist(), [known] * batch.num_rows)

        return rows.mapInArrow(run, shape)

    return _by_pieces(rows, wanted, key, kind)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, in 64 bits."""
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _hashes(texts: list[str], lengths: list[int]):
    """(length, hashes of all pieces of that length, whether each lies within one text, each place's text, each text's first place)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner, n = np.repeat(np.arange(len(texts)), sizes), len(codes)
    powers, back = _powers(1 << max(n, 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes * np.uint64(_MIX[0]) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    for length in lengths:
        if length <= n:
            h = (sums[length:] - sums[:-length]) * back[: n - length + 1] + np.uint64(length)
            yield length, h ^ (h >> np.uint64(32)), owner[: n - length + 1] == owner[length - 1 :], owner, np.cumsum(sizes) - sizes


def _bit(h: np.ndarray, probe: int, log: int) -> np.ndarray:
    return (h * np.uint64(_MIX[probe])) >> np.uint64(64 - log)


def _by_pieces(rows: DataFrame, wanted: DataFrame, key: str, kind: str) -> DataFrame:
    @F.pandas_udf("string")
    def lower(names: pd.Series) -> pd.Series:
        return names.map(str.lower)  # as texts are lowered

    forms = wanted.withColumn("form", lower("name"))
    total, lengths = forms.agg(F.count(F.lit(1)), F.collect_set(F.length("form"))).first()  # the lengths are few numbers
    lengths, log = sorted(lengths), min(MOST_LOG, max(LEAST_LOG, (BITS * total - 1).bit_length()))

    def bits(batches):
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            by_length: dict[int, list[str]] = {}
            for form in batch.column(0).to_pylist():
                by_length.setdefault(len(form), []).append(form)
            for length, same in by_length.items():
                for _, h, _, _, _ in _hashes(same, [length]):
                    found += [_bit(h[::length], probe, log) for probe in range(len(_MIX))]
            at = np.unique(np.concatenate(found)).astype(np.int64)
            yield pa.record_batch([pa.array(at >> SPAN_LOG), pa.array(at & ((1 << SPAN_LOG) - 1))], names=["span", "bit"])

    def packed(t: pa.Table) -> pa.Table:
        span = np.zeros(1 << SPAN_LOG, np.uint8)
        span[t.column(1).to_numpy()] = 1
        return pa.table({"span": t.column(0).slice(0, 1), "bits": pa.array([np.packbits(span, bitorder="little").tobytes()], pa.binary())})

    held = np.zeros(1 << (log - 3), np.uint8)
    for r in forms.select("form").mapInArrow(bits, "span long, bit long").distinct().groupBy("span").applyInArrow(packed, "span long, bits binary").collect():  # the filter, of bounded size
        held[r["span"] << (SPAN_LOG - 3) : (r["span"] + 1) << (SPAN_LOG - 3)] = np.frombuffer(r["bits"], np.uint8)
    filtered = rows.sparkSession.sparkContext.broadcast(held)

    def pieces(batches):
        for batch in batches:
            texts, a = [t.lower() for t in batch.column(1).to_pylist()], 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= CHARACTERS):
                    size += len(texts[b])
                    b += 1
                row, at, form = [], [], []
                for length, h, within, owner, first in _hashes(texts[a:b], lengths):
                    spots = np.flatnonzero(within)
                    for probe in range(len(_MIX)):
                        bit = _bit(h[spots], probe, log).astype(np.int64)
                        spots = spots[(filtered.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
                    seen = set()
                    for spot in spots.tolist():
                        i = int(owner[spot])
                        place = spot - int(first[i])
                        piece = texts[a + i][place : place + length]
                        if (i, piece) not in seen:  # the first place of each
                            seen.add((i, piece))
                            row.append(a + i)
                            at.append(place)
                            form.append(piece)
                yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(form, pa.string())], names=[key, "at", "form"])
                a = b

    # a piece that stands in very many texts is dealt over several tasks
    found = rows.mapInArrow(pieces, f"{key} {kind}, at int, form string").withColumn("_s", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    known = forms.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.join(known, ["form", "_s"]).select(key, "at", "name")
