"""BPE encoding and decoding by speculation and verification.

Text is cut at white space; each different piece is normalised and split into
words once and kept.  A word's proposal is the greedy longest match over the
vocabulary.  A sequence of tokens is what the merges give exactly if every two
neighbours are (each pair, merged on its own, stays that pair), so one vectorised
lookup tests all adjacent pairs of a batch of words against the pairs already
judged, and only words with an incompatible pair go through the merges.

The result is that of the tokenizer file: NFC, white space, lower case by single
characters, its special tokens wherever their strings stand, words by its pattern,
bytes as its visible characters; characters without a token are left out.
Decoding (the file names no decoder) joins the tokens with spaces.

Null and empty texts give no ids and an empty decoded text.  The piece table is
bounded (``CACHE`` entries; the older half goes when it is full), whatever the corpus holds,
and very long texts are encoded whole.  Repeated rows give repeated results; an
empty table an empty one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

CACHE = 500_000
LONG_PIECE = 4096
LONG_WORD = 64  # letters; longer words are merged one by one
OLD = unicodedata.ucd_3_2_0
_MODELS: dict[str, "Bpe"] = {}


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Recent:
    """A table of at most ``CACHE`` entries: what was not asked for lately goes, half at a time."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Keys that are not there; those that are count as young from now on."""
        if len(self.young) + len(keys) > CACHE // 2:
            self.old, self.young = self.young, {}
        new = keys.difference(self.young)
        if self.old:
            old = self.old
            again = [k for k in new if k in old]
            self.young.update((k, old[k]) for k in again)
            new.difference_update(again)
        return list(new)


class Bpe:
    """A BPE with an end-of-word suffix, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.joined = [ids[a + b] for a, b in merges]  # by rank
        self.letters = _byte_letters()
        made = {joined for _, joined in self.merges.values()}
        single = {ids[c] for c in self.letters if c in ids} | {ids[c + self.suffix] for c in self.letters if c + self.suffix in ids}
        # only tokens that the merges can reach may be proposed
        self.inner = {t: i for t, i in ids.items() if (i in made or i in single) and not (self.suffix and t.endswith(self.suffix))}
        self.final = {t[: len(t) - len(self.suffix)]: i for t, i in ids.items() if (i in made or i in single) and self.suffix and t.endswith(self.suffix)} if self.suffix else self.inner
        lengths: dict[str, set[int]] = {}
        for t in self.inner:
            lengths.setdefault(t[:3], set()).add(len(t))
        self.reach = {head: tuple(sorted(some, reverse=True)) for head, some in lengths.items() if len(head) == 3}  # by the first three letters, the lengths of their tokens, longest first
        self.longest = max(map(len, self.final), default=0)
        self.reachable: dict[int, bool] = {}
        self.known = np.empty(0, np.int64)  # pairs judged so far, sorted
        self.verdict = np.empty(0, bool)
        self.exact_words = self.proposed_words = 0
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V1)
        self.mark_heads = tuple({s[0] for s in self.special})
        self.letters_are_one = all(self.pattern.findall(w) == [w] for w in ("abcdefghijklmnopqrstuvwxyz", "s", "re", "ll"))
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.path, self.library = path, None
        letters = [chr(c) for c in range(max(map(ord, self.letters)) + 2)]  # the last one stands for all that are no byte letter
        of = lambda end: np.array([*(ids.get(c + end, -1) for c in letters[:-1]), -1], np.int64)
        self.inner_of, self.final_of = of(""), of(self.suffix)
        keys = np.array([(a << 32) | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        self.joined_ids = np.array(self.joined, np.int64)
        self.coded = {i: i.to_bytes(4, "little") for i in self.names}
        self.said = [f" {self.names.get(i, '')}".encode() for i in range(max(self.names, default=-1) + 1)]
        self.cache, self.word_cache = Recent(), Recent()

    def merged(self, symbols: list[int]) -> list[int]:
        """The merges themselves: the pair of the lowest rank first, the leftmost of equals."""
        symbols = list(symbols)
        if len(symbols) > LONG_WORD:
            return self._merged_long(symbols)
        get, none = self.ranks.get, len(self.joined)
        ranks = list(map(get, zip(symbols, symbols[1:], strict=False), repeat(none)))  # of each neighbouring pair
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at] = to = self.joined[best]
            del symbols[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((symbols[at - 1], to), none)
            if at < len(ranks):
                ranks[at] = get((to, symbols[at + 1]), none)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        import heapq

        n = len(symbols)
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], right[i] = to, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (m := self.merges.get((symbols[k], symbols[right[k]]))):
                    heapq.heappush(heap, (m[0], k, symbols[k], symbols[right[k]], m[1]))
        return [s for s, ok in zip(symbols, alive, strict=True) if ok]

    def symbols(self, word: str) -> list[int]:
        """A word's single characters as ids; those without a token are left out."""
        last = len(word) - 1
        found = (self.vocab.get(c + self.suffix if i == last else c) for i, c in enumerate(word))
        return [i for i in found if i is not None]

    def proposal(self, word: str) -> list[int] | None:
        """Greedy longest match; None if it gets stuck."""
        out, at, n = [], 0, len(word)
        inner, final, longest, reach = self.inner, self.final, self.longest, self.reach
        most = n - (1 if self.suffix else 0)
        while at < n:
            if n - at <= longest and (i := final.get(word[at:])) is not None:
                out.append(i)
                return out
            for size in (*reach.get(word[at : at + 3], ()), 2, 1):
                if at + size <= most and (i := inner.get(word[at : at + size])) is not None:
                    out.append(i)
                    at += size
                    break
            else:
                return None
        return out if not self.suffix else None

    def merged_many(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of words by the merges: each round makes every word's next merge at once."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = self.inner_of[np.minimum(text, len(self.inner_of) - 1)]
        last = np.cumsum(lengths)[lengths > 0] - 1
        flat[last] = self.final_of[np.minimum(text[last], len(self.final_of) - 1)]
        owner = np.repeat(np.arange(len(words)), lengths)[flat >= 0]
        flat = flat[flat >= 0]
        none, parts = len(self.joined), []
        while len(flat):
            begins = np.append(True, owner[1:] != owner[:-1])
            pairs = (flat[:-1] << 32) | flat[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, pairs), max(none - 1, 0))
            rank = np.full(len(flat), none)  # of each symbol with the next one
            if none:
                rank[:-1] = np.where((self.pair_keys[at] == pairs) & ~begins[1:], self.pair_ranks[at], none)
            first = np.flatnonzero(begins)
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(flat))))
            live = best < none
            parts.append((owner[~live], flat[~live]))
            flat, owner, rank, best = flat[live], owner[live], rank[live], best[live]
            here = np.flatnonzero(rank == best)
            here = here[np.append(True, owner[here][1:] != owner[here][:-1])] if len(here) else here  # the leftmost of equals
            flat[here] = self.joined_ids[rank[here]]
            stays = np.ones(len(flat), bool)
            stays[here + 1] = False
            flat, owner = flat[stays], owner[stays]
        owner, flat = (np.concatenate([x[k] for x in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))
        raw = flat[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def _judge(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a == b == 0xFFFFFFF:
            return True
        one, two = self.names[a], self.names[b]
        closed = bool(self.suffix) and two.endswith(self.suffix)
        word = one + (two[: len(two) - len(self.suffix)] if closed else two)
        units = self.symbols(word) if closed or not self.suffix else [self.vocab[c] for c in word if c in self.vocab]
        return self.merged(units) == [a, b]

    def _alone(self, token: int) -> bool:
        if token not in self.reachable:
            name = self.names[token]
            closed = bool(self.suffix) and name.endswith(self.suffix)
            word = name[: len(name) - len(self.suffix)] if closed else name
            self.reachable[token] = self.merged(self.symbols(word) if closed or not self.suffix else [self.vocab[c] for c in word if c in self.vocab]) == [token]
        return self.reachable[token]

    def words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of words (in byte letters): proposals, all pairs tested at once, merges for those that fail."""
        out = [self.proposal(w) for w in words]
        lengths = np.fromiter((len(x) if x else 0 for x in out), np.int64, len(out))
        flat = np.fromiter((t for x in out if x for t in x), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(out)), lengths)
        good = np.array([x is not None for x in out], bool)
        if len(flat):
            alone = {int(t): self._alone(int(t)) for t in np.unique(flat)}
            bad = [t for t, ok in alone.items() if not ok]
            if bad:
                good[owner[np.isin(flat, bad)]] = False
        if len(flat) > 1:
            same = owner[1:] == owner[:-1]
            pairs = ((flat[:-1] << 32) | flat[1:])[same]
            fresh = np.unique(pairs)
            at = np.searchsorted(self.known, fresh)
            seen = (at < len(self.known)) & (self.known[np.minimum(at, max(len(self.known) - 1, 0))] == fresh) if len(self.known) else np.zeros(len(fresh), bool)
            fresh = fresh[~seen]
            if len(fresh):
                if len(self.known) > 4_000_000:
                    self.known, self.verdict, fresh = np.empty(0, np.int64), np.empty(0, bool), np.unique(pairs)
                told = np.fromiter((self._judge(int(p)) for p in fresh), bool, len(fresh))
                known, verdict = np.concatenate([self.known, fresh]), np.concatenate([self.verdict, told])
                order = np.argsort(known, kind="stable")
                self.known, self.verdict = known[order], verdict[order]
            ok = self.verdict[np.searchsorted(self.known, pairs)] if len(pairs) else np.empty(0, bool)
            good[owner[1:][same][~ok]] = False
        self.proposed_words += len(words)
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        told = [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]
        wrong = np.flatnonzero(~good).tolist()
        short = [i for i in wrong if len(words[i]) <= LONG_WORD]
        for i, ids in zip(short, self.merged_many([words[i] for i in short]), strict=True):
            told[i] = ids
        for i in wrong:
            if len(words[i]) > LONG_WORD:
                told[i] = np.array(self.merged(self.symbols(words[i])), "<u4").tobytes()
        self.exact_words += len(wrong)
        return told

    def split(self, piece: str) -> list[tuple[str, int]]:
        """A piece's words in byte letters, and special ids: (word, -1) or ("", id)."""
        out = []
        for k, part in enumerate(self.marks.split(piece) if any(c in piece for c in self.mark_heads) else [piece]):
            if k % 2:
                out.append(("", self.special[part]))
            elif part:
                if not part.isascii() and any(OLD.category(c) == "Cn" for c in part if c > "\x7f"):
                    out += [(w, -1) for w in self.split_by_library(part)]
                elif not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    part = part.lower()
                    out += [("".join([self.letters[b] for b in w.encode("utf-8", "replace")]), -1) for w in self.pattern.findall(part)]
                else:
                    letters = self.letters
                    out += [(w if w.isprintable() else "".join([letters[ord(c)] for c in w]), -1) for w in self.pattern.findall(part.lower())]
        return out

    def split_by_library(self, part: str) -> list[str]:
        """Words of a piece with characters that Unicode 3.2 did not have: tables of letters differ, so the library's own decides."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Little-endian ids of pieces."""
        whole = {p: p.lower() for p in pieces if p.isalpha() and p.isascii()} if self.letters_are_one else {}
        split = {p: self.split(p) for p in pieces if p not in whole}
        known, coded = self.word_cache, self.coded
        asked = set(whole.values())
        asked.update([w for ws in split.values() for w, i in ws if i < 0])
        new = known.missing(asked)
        known.young.update(zip(new, self.words(new), strict=True))
        table = known.young
        out = {p: table[w] for p, w in whole.items()}
        for piece, ws in split.items():
            out[piece] = table[ws[0][0]] if len(ws) == 1 and ws[0][1] < 0 else b"".join([table[w] if i < 0 else coded[i] for w, i in ws])
        return out

    def pieces(self, text: str) -> list[str]:
        """A text cut at white space (the few characters that Python takes for more are handled apart)."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [p for p in regex.split(r"\p{White_Space}+", text) if p]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[tuple[list[str], dict[str, bytes]]]:
        """Each text's pieces, with a table of their ids that has them all."""
        cut = [self.pieces(t) if t else [] for t in texts]
        new = self.cache.missing(set().union(*cut))
        long = [p for p in new if len(p) > LONG_PIECE]
        self.cache.young.update(self.learn([p for p in new if len(p) <= LONG_PIECE]))
        table = self.cache.young
        if long:  # not kept
            table = table | {p: v for x in long for p, v in self.learn([x]).items()}
        return [(c, table) for c in cut]

    def encode_ids(self, text: str | None) -> np.ndarray:
        ((cut, table),) = self.encode([text])
        return np.frombuffer(b"".join([table[p] for p in cut]), "<u4")

    def decoded(self, raw: bytes) -> bytes:
        """The text of little-endian ids, in UTF-8."""
        return b"".join(map(self.said.__getitem__, np.frombuffer(raw, "<u4").tolist()))[1:]

    def decode(self, ids) -> str:
        return " ".join(self.names[int(i)] for i in ids)


def model(path: str) -> Bpe:
    """One per process."""
    if path not in _MODELS:
        _MODELS[path] = Bpe(path)
    return _MODELS[path]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, contents: bool = False) -> DataFrame:
    """Per document n_tokens, ids_sha256 and decoded_sha256; with ``contents`` also ids and decoded."""
    path = path or default_file()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if contents else "")

    def run(batches):
        bpe = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, a, b, ids, decoded = [], [], [], [], []
                for cut, table in bpe.encode(part.column(1).to_pylist()):
                    raw = b"".join(map(table.__getitem__, cut))
                    back = bpe.decoded(raw)
                    n.append(len(raw) // 4)
                    a.append(hashlib.sha256(raw).hexdigest())
                    b.append(hashlib.sha256(back).hexdigest())
                    if contents:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                        decoded.append(back.decode())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if contents:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.record_batch(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
