import math
import os

import pytest
from pyspark.sql import functions as F

from sparkwright.operators import chunking, html_blocks, sections, validate

PAGE = """<html><head><title>t</title><script>var a="<p>no</p>"</script></head><body><div style="display: none"><p>hidden</p></div>
<p>Table of Contents</p><p>Item 1. Business</p><p>Item 1A. Risk Factors</p><p>12</p>
<p>ITEM <span>1. BUSI</span><span>NESS</span></p><p>%s</p><div>loose<p>Item 1A. Risk Factors</p></div><p>%s""" % ("We build. " * 40, "Risks. " * 40)


def test_blocks():
    found = html_blocks.leaf_blocks(PAGE)
    assert ("p", "ITEM  1. BUSI NESS") in found and not any("hidden" in t or "no" == t or "loose" in t for _, t in found)
    assert html_blocks.leaf_blocks("") == [] and html_blocks.leaf_blocks("<p>a<p>b<li>c") == [("p", "a"), ("p", "b"), ("li", "c")]


def test_broken_tags():
    """Unclosed tags, quotes, comments and scripts: what can be read is read, in linear time."""
    import time

    first = "<p>first</p>"
    begun = time.time()
    for k in (50_000, 100_000):
        for broken in ("<a " * k, "<a x='" * k, '<a x="' * k + ">", "<!-- " * k, "<p a=" * k + ">", "<script>" * k, "<b" * k, "</p" * k, "<" * k, "<a x='>" * k, "<a " + "= " * k, "<p>x" * k, "<?" * k):
            assert html_blocks.leaf_blocks(first + broken)[0] == ("p", "first"), broken[:20]
    assert time.time() - begun < 30
    for page, want in [
        ("<p>1 < 2 &amp; 3 > 2</p>", [("p", "1 < 2 & 3 > 2")]),
        ("<p title='a > b'>x</p>", [("p", "x")]),
        ("<p title=it's>x</p><p>y</p>", [("p", "x"), ("p", "y")]),
        ('<p title="no end>x</p><p>y</p>', [("p", "x"), ("p", "y")]),
        ("<p>a<!-- <p>no</p> -->b</p>", [("p", "a b")]),
        ("<p>a<script>if (a < b) '</p>'</script >b</p>", [("p", "a b")]),
        ("<P STYLE='Display : None'>x</P><p>y<br/>z</p><div/>w", [("p", "y z"), ("div", "")]),
        ("<p>a <a href", [("p", "a <a href")]),
    ]:
        assert html_blocks.leaf_blocks(page) == want, page


def test_sections(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>only</p>"), (3, None), (4, "<p>before</p><p>Item 2.</p>")], "page_id long, html string")
    found = {(r["page_id"], r["section_pos"]): (r["section_path"], r["text"]) for r in sections.split_sections(html_blocks.paragraphs(pages)).collect()}
    assert found[1, 0][0] == "Item 1. Business" or found[1, 0][0] == "Front Matter"
    assert found[2, 0] == ("Full Document", "only")
    assert found[4, 0] == ("Front Matter", "before") and found[4, 1] == ("Item 2.", "")
    risk = [v for (p, _), v in found.items() if p == 1 and v[0] == "Item 1A. Risk Factors"]
    assert len(risk) == 1 and risk[0][1].startswith("Risks.")


@pytest.mark.parametrize(("n", "target", "overlap"), [(0, 5, 2), (1, 5, 2), (5, 5, 2), (6, 5, 2), (23, 5, 4), (100, 7, 0)])
def test_windows(spark, n, target, overlap):
    text = " ".join(f"w{i}" for i in range(n))
    rows = spark.createDataFrame([(text,)], "t string").select(chunking.tokens(F.col("t")).alias("tokens"))
    got = [r["piece"].split() for r in chunking.windows(rows, "tokens", target, overlap).orderBy("window_pos").collect()]
    words, want, at = text.split(), [], 0
    while words:
        want.append(words[at : at + target])
        if at + target >= n:
            break
        at += target - overlap
    assert got == want and len(got) == (0 if n == 0 else 1 if n <= target else math.ceil((n - overlap) / (target - overlap)))


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        chunking.windows(spark.range(1).select(F.array().cast("array<string>").alias("tokens")), "tokens", 5, 5)


def test_chunks(spark):
    docs = spark.createDataFrame([("d", [("A", " ".join(["x"] * 25)), ("B", "  \n "), ("C", "one two")], {"company": "Acme"}, "10-K")], "document_id string, sections array<struct<section_path string, text string>>, metadata map<string,string>, document_type string").withColumn("date", F.to_date(F.lit("2024-02-03")))
    rows = chunking.chunk_documents(docs, 10, 2).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == [f"d_{i:05d}" for i in range(len(rows))] and [r["section_path"] for r in rows] == ["A"] * 3 + ["C"]
    assert rows[0]["metadata"] == {"company": "Acme", "ticker": None, "document_type": "10-K", "date": "2024-02-03"}


def test_validation(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (None,), (-0.1,)], "c double")
    good, bad = validate.split_valid(rows, validate.in_unit(F.col("c")))
    assert good.count() == 2 and bad.count() == 3


def test_dangling(spark):
    names = spark.createDataFrame([("c1", "A"), ("c1", "B"), ("c2", "A")], "source_chunk_id string, raw_name string")
    claims = spark.createDataFrame([("c1", "A", "B"), ("c1", "A", "a"), ("c2", "A", "B")], "source_chunk_id string, source_entity string, target_entity string")
    assert [tuple(r) for r in validate.drop_dangling(names, claims).select("source_chunk_id", "source_entity", "target_entity").collect()] == [("c1", "A", "B")]


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no ranks")
def test_windows_of_byte_pairs(spark):
    """As many tokens as the encoder counts; windows without overlap join to the text, even where one cuts a character."""
    import tiktoken

    from sparkwright.functions import bpe

    ranks = bpe.load_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["A filing of 2024, with figures.", "日本語のテキスト 😀😀 ünïcödé", "", None, "  \n\n  x", "word " * 500, "<|endoftext|>"]
    tokenize = bpe.byte_pair_tokens(ranks, PATTERN)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", "t", tokenize(F.col("t")).alias("tokens"))
    for r in rows.select("id", "t", F.size("tokens").alias("n"), bpe.as_text(F.array_join("tokens", "")).alias("whole")).collect():
        assert r["n"] == len(encoding.encode_ordinary(r["t"] or "")) and r["whole"] == (r["t"] or "")
    pieces = chunking.windows(rows, "tokens", 3, 0).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("window_pos", "piece"))).alias("p"))
    joined = {r["id"]: r["t"] for r in pieces.select("id", bpe.as_text(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("t")).collect()}
    assert joined == {i: t for i, t in enumerate(texts) if t}
    got = chunking.windows(rows, "tokens", 5, 2).select("id", "window_pos", bpe.as_text(F.col("piece")).alias("text")).collect()
    for r in got:
        ids = encoding.encode_ordinary(texts[r["id"]])[3 * r["window_pos"] : 3 * r["window_pos"] + 5]
        assert r["text"] == encoding.decode(ids)
    docs = spark.createDataFrame([("d", {"company": "X"}, "text", None, [("s", texts[5])])], "document_id string, metadata map<string,string>, document_type string, date date, sections array<struct<section_path string, text string>>")
    chunks = chunking.chunk_documents(docs, 100, 10, tokenize, bpe.as_text).orderBy("chunk_index").collect()
    assert len(chunks) == 6 and all(set(c["text"].split()) == {"word"} for c in chunks) and len(encoding.encode_ordinary(" " + chunks[1]["text"])) == 100


def test_only_whole_references_are_decoded():
    page = "<h1>a &amp;&amp;&amp</h1><p>&lt;b&gt; &copy &#65; &#x42 &nosuch; &notit; &amp;lt; &</p>"
    assert html_blocks.leaf_blocks(page) == [("h1", "a &&&amp"), ("p", "<b> &copy A B &nosuch; &notit; &lt; &")]
