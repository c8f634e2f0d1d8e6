"""Extraction of entities and relationships: pluggable extractor, cache, retries, accounting."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import cache_key
from ..ontology import Ontology
from ..plans.scratch import Scratch

PROMPT_VERSION, SCHEMA_VERSION = "1", "1"
# Token budget of a first try, tries in all, dollars for a million tokens in and out.
FIRST_BUDGET, TRIES = 8192, 3
PRICE_IN, PRICE_OUT = 2.0, 10.0


class Truncated(Exception):
    """An extractor ran out of its token budget."""


#: Fixed value: what a filer without a company name is called.
NO_FILER = "the filer"


def filer(metadata: Column) -> Column:
    """Whom a chunk's text means where it speaks of itself; extractors get it beside the text."""
    return F.coalesce(F.try_element_at(metadata, F.lit("company")), F.lit(NO_FILER))


#: What a filer calls itself where a sentence's subject or object is meant; "us" and "our" alone say too little ("US regulators").
SELF = r"\b(?:[Ww]e|[Tt]he Company|[Oo]ur [Cc]ompany)\b"


def rule_extractor(names: dict[str, str], ontology: Ontology | None = None) -> Callable[[str, str, int, str], str]:
    """A deterministic extractor: known names (name -> type), and a verb between two of them in a sentence.

    Where a text speaks of itself the filer is meant: it is an entity under its own name, and the text stays as it is."""
    ontology = ontology or Ontology()
    verbs = [(v, r) for r, _, _, v in ontology.relationships]
    pattern = re.compile("|".join([*(re.escape(n) for n in sorted(names, key=len, reverse=True)), SELF]))

    def extract(section: str, text: str, budget: int, filer: str = NO_FILER) -> str:
        entities, relations = {}, {}
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            found = [(m.start(), m.end(), m[0] if m[0] in names else filer) for m in pattern.finditer(sentence)]
            for _, _, n in found:
                entities[n] = names.get(n, "Company")
            for (_, end, a), (start, _, b) in zip(found, found[1:], strict=False):
                for verb, kind in verbs:
                    if verb in sentence[end:start] and a != b:
                        relations[kind, a, b] = 0.9
        return json.dumps({
            "entities": [{"entity_type": t, "raw_name": n, "confidence": 1.0} for n, t in entities.items()],
            "relationships": [{"relationship_type": k, "source_entity": a, "target_entity": b, "confidence": c} for (k, a, b), c in relations.items()],
        })

    return extract


def parsed(raw: str, ontology: Ontology) -> dict:
    """The output as a record in the ontology's form; raises ValueError or KeyError where it is not."""
    out = json.loads(raw)
    for e in out["entities"]:
        if e["entity_type"] not in ontology.entity_types or not 0 <= e["confidence"] <= 1:
            raise ValueError(f"bad entity {e}")
    names = {e["raw_name"] for e in out["entities"]}
    for r in out["relationships"]:
        if r["relationship_type"] not in ontology.relationship_types or not 0 <= r["confidence"] <= 1:
            raise ValueError(f"bad relationship {r}")
    out["relationships"] = [r for r in out["relationships"] if r["source_entity"] in names and r["target_entity"] in names]
    return out


def extract_once(extract: Callable[[str, str, int, str], str], section: str, text: str, ontology: Ontology, filer: str = NO_FILER) -> dict:
    """Up to three tries: a truncated one doubles the budget, an invalid one is repeated, the last failure is raised."""
    budget = FIRST_BUDGET
    for k in range(TRIES):
        try:
            return parsed(extract(section, text, budget, filer), ontology)
        except Truncated:
            budget *= 2
            if k == TRIES - 1:
                raise
        except (ValueError, KeyError):
            if k == TRIES - 1:
                raise
    raise AssertionError


def with_keys(chunks: DataFrame, model: str) -> DataFrame:
    return chunks.withColumn("cache_key", cache_key(F.col("chunk_id"), F.lit(model), F.lit(PROMPT_VERSION), F.lit(SCHEMA_VERSION), F.col("text")))


def extract_chunks(chunks: DataFrame, extract: Callable[[str, str, int, str], str], cache: DataFrame | None = None, model: str = "rules", ontology: Ontology | None = None, workers: int = 1) -> DataFrame:
    """(chunk_id, cache_key, result, input_tokens, output_tokens, from_cache): cached chunks are not extracted again.

    ``workers`` calls of an extractor that waits for a remote service run at a time in each task; results keep their order."""
    ontology = ontology or Ontology()
    keyed = with_keys(chunks, model).withColumn("filer", filer(F.col("metadata")))
    schema = f"chunk_id string, cache_key string, result {schemas.EXTRACTION.simpleString()}, input_tokens long, output_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(workers) if workers > 1 else None
        for batch in batches:
            asked = zip(batch["section_path"], batch["text"], batch["filer"], strict=True)
            results = list((pool.map if pool else map)(lambda x: extract_once(extract, x[0], x[1], ontology, x[2]), asked))
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "cache_key": batch["cache_key"], "result": results, "input_tokens": [len((t or "").split()) for t in batch["text"]], "output_tokens": [len(json.dumps(r).split()) for r in results]})

    fresh = keyed if cache is None else keyed.join(cache, "cache_key", "left_anti")
    made = fresh.select("chunk_id", "cache_key", "section_path", "text", "filer").mapInPandas(run, schema).withColumn("from_cache", F.lit(False))
    if cache is None:
        return made
    hits = keyed.select("chunk_id", "cache_key").join(cache, "cache_key").select("chunk_id", "cache_key", "result", "input_tokens", "output_tokens", F.lit(True).alias("from_cache"))
    return made.unionByName(hits)


RAW = "chunk_id string, cache_key string, raw string, tries int, reason string, input_tokens long, output_tokens long"


def asked(extract: Callable[[str, str, int, str], str], section: str, text: str, ontology: Ontology, filer: str = NO_FILER) -> tuple[str | None, int, str | None]:
    """(output, tries, None) of the first output that is in the ontology's form, or (last output, tries, why it was refused); nothing is raised."""
    budget, raw, reason = FIRST_BUDGET, None, None
    for k in range(1, TRIES + 1):
        try:
            raw = extract(section, text, budget, filer)
            parsed(raw, ontology)
            return raw, k, None
        except Truncated:
            budget, reason = budget * 2, "truncated"
        except json.JSONDecodeError:
            reason = "not JSON"
        except (ValueError, KeyError, TypeError) as e:
            reason = "not in form: " + (str(e) if isinstance(e, ValueError) else f"{type(e).__name__} {e}")
        except Exception as e:  # an extractor's own failure concerns its chunk alone
            reason = f"failed: {type(e).__name__}"
    return raw, TRIES, reason


def extract_all(chunks: DataFrame, extract: Callable[[str, str, int, str], str], cache: DataFrame | None = None, model: str = "rules", ontology: Ontology | None = None, workers: int = 1) -> tuple[DataFrame, DataFrame]:
    """(results as :func:`extract_chunks` has them, rejects (chunk_id, cache_key, reason, tries, raw)): a chunk without a good answer ends nothing.

    The answers are kept in the shared folder once, so that neither table asks again.  They are parsed in the JVM with the
    declared schema; what does not fit it there is a reject, too."""
    ontology = ontology or Ontology()
    keyed = with_keys(chunks, model).withColumn("filer", filer(F.col("metadata")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(workers) if workers > 1 else None
        for batch in batches:
            rows = zip(batch["section_path"], batch["text"], batch["filer"], strict=True)
            told = list((pool.map if pool else map)(lambda x: asked(extract, x[0], x[1], ontology, x[2]), rows))
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "cache_key": batch["cache_key"], "raw": [t[0] for t in told], "tries": [t[1] for t in told], "reason": [t[2] for t in told], "input_tokens": [len((t or "").split()) for t in batch["text"]], "output_tokens": [len((t[0] or "").split()) for t in told]})

    fresh = keyed if cache is None else keyed.join(cache, "cache_key", "left_anti")
    answers = Scratch(chunks.sparkSession, "answers").keep(fresh.select("chunk_id", "cache_key", "section_path", "text", "filer").mapInPandas(run, RAW), "raw")
    form = schemas.EXTRACTION.simpleString().removesuffix(">") + ",_corrupt:string>"
    read = answers.withColumn("_r", F.from_json("raw", form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    read = read.withColumn("reason", F.coalesce("reason", F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "not in the schema")))
    names = F.transform("_r.entities", lambda e: e["raw_name"])
    whole = F.filter("_r.relationships", lambda r: F.array_contains(names, r["source_entity"]) & F.array_contains(names, r["target_entity"]))
    result = F.struct(F.col("_r.entities").alias("entities"), whole.alias("relationships")).cast(schemas.EXTRACTION)
    made = read.filter("reason is null").select("chunk_id", "cache_key", result.alias("result"), "input_tokens", "output_tokens", F.lit(False).alias("from_cache"))
    rejects = read.filter("reason is not null").select("chunk_id", "cache_key", "reason", "tries", "raw")
    if cache is None:
        return made, rejects
    hits = keyed.select("chunk_id", "cache_key").join(cache, "cache_key").select("chunk_id", "cache_key", "result", "input_tokens", "output_tokens", F.lit(True).alias("from_cache"))
    return made.unionByName(hits), rejects


def dollars(tokens_in: Column, tokens_out: Column) -> Column:
    return F.round(F.coalesce(tokens_in, F.lit(0)) / 1e6 * PRICE_IN + F.coalesce(tokens_out, F.lit(0)) / 1e6 * PRICE_OUT, 4)


def accounting(results: DataFrame) -> DataFrame:
    """Chunks, cached ones, tokens and cost by document, and in all (document_id null); an empty input gives the total alone."""
    sums = [F.count(F.lit(1)).alias("chunks"), F.coalesce(F.count_if("from_cache"), F.lit(0)).alias("cached"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")]
    every = results.groupBy("document_id").agg(*sums).unionByName(results.agg(*sums).select(F.lit(None).cast(results.schema["document_id"].dataType).alias("document_id"), "*"))
    return every.withColumn("cost", dollars(F.col("input_tokens"), F.col("output_tokens")))


def total_cost(cache: DataFrame) -> DataFrame:
    """One row: cached results, tokens and dollars."""
    sums = cache.agg(F.count(F.lit(1)).alias("results"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return sums.withColumn("cost", dollars(F.col("input_tokens"), F.col("output_tokens")))
