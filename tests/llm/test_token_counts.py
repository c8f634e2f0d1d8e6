from sparkwright.llm import token_counts


def test_against_brute_force(spark, odd):
    encode = token_counts.encoder(token_counts.default_ranks()).encode_ordinary
    sizes = [len(encode(r["text"] or "")) for r in odd.collect()]
    table = token_counts.suffix_sums(token_counts.length_histogram(odd), block=8)
    rows = {r["context_limit"]: r for r in table.collect()}
    assert set(rows) == set(sizes)
    for limit, r in rows.items():
        assert r["docs"] == sizes.count(limit) and r["docs_from"] == sum(s >= limit for s in sizes) and r["tokens_from"] == sum(s for s in sizes if s >= limit)
        assert r["tokens_kept"] == sum(min(s, limit) for s in sizes) and r["tokens_kept"] + r["tokens_cut"] == sum(sizes) and r["docs_cut"] == sum(s > limit for s in sizes)
    for r in token_counts.truncated_totals(table, [0, 3, 10**9]).collect():
        assert r["tokens_kept"] == sum(min(s, r["limit"]) for s in sizes) and r["docs_cut"] == sum(s > r["limit"] for s in sizes)
    ordered = sorted(sizes)
    for r in token_counts.quantiles(table, [0.5, 1.0]).collect():
        assert r["length"] == next(x for x in ordered if sum(s <= x for s in sizes) >= r["share"] * len(sizes))


def test_empty(make):
    assert token_counts.suffix_sums(token_counts.length_histogram(make([]))).collect() == []


def test_long_white_space(spark, make, monkeypatch):
    """Runs that the pattern's engine cannot take have the counts that shorter runs' rule gives."""
    import random
    import re

    encode = token_counts.encoder(token_counts.default_ranks())
    texts = [" " * 1_000_000 + "x", "a" + "\n" * 1_000_000, "\t " * 500_000 + "\n\nb  c"]
    sizes = [token_counts.token_count(encode, t) for t in texts]
    assert sizes[0] == len(encode._encode_single_piece(" " * 999_999)) + len(encode.encode_ordinary(" x"))
    assert sorted(r["length"] for r in token_counts.length_histogram(make(texts)).collect()) == sorted(sizes)
    monkeypatch.setattr(token_counts, "_LONG_RUN", re.compile(token_counts._LONG_RUN.pattern.replace("4096", "3")))
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice([" ", " ", "\n", "\t", "a", "7", ".", "'s", "é", "　", "\x1c", "\x85"]) for _ in range(rng.randrange(40)))
        assert token_counts.token_count(encode, t) == len(encode.encode_ordinary(t))
