"""Packing documents into fixed windows by non-negative least squares over length patterns."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed_rank, cut, give_back

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Patterns that the least-squares step considers at most, and its steps.
PATTERNS, STEPS = 4096, 200
#: Distinct words whose ids a Python worker keeps; then it starts afresh. FEW_WORDS holds where other stages share the workers.
CACHE_WORDS, FEW_WORDS = 1_500_000, 150_000
#: Words that the tokenizer encodes at a time; its results take about a kilobyte a word until they are read.
ENCODED = 4096
#: Bytes of text that are split into words at a time (a longer text by itself), with and without `remember`.
SLICE_BYTES, FEW_BYTES = 16 << 20, 2 << 20
#: Rows of one length that a task numbers; longer lists are dealt over more tasks. At most PARTS parts up to MOST_ROWS rows in each.
LEAST_ROWS, MOST_ROWS, PARTS = 500, 200_000, 1000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Ids:
    """Ids of whole texts, looked up word by word.

    Where the tokenizer lowers case and splits at white space before anything else that looks beyond a character, a
    text's ids are those of its space-separated parts in turn, and a part's ids are kept. A run of letters is one word of
    the tokenizer, whose last token bears the mark of a word's end, so many are encoded as one text and told apart by that
    mark; a comma or full stop after such a word is a token of its own. Any other tokenizer encodes whole texts.
    """

    def __init__(self, file: str, most: int = CACHE_WORDS):
        import json

        from tokenizers import Tokenizer

        self.most, self.model = most, Tokenizer.from_str(file)
        config = json.loads(file)
        suffix = config["model"].get("end_of_word_suffix")
        kinds = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", ())]
        splits = [n["type"] for n in (config.get("pre_tokenizer") or {}).get("pretokenizers", ())]
        self.wordwise = bool(suffix) and kinds == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[v for k, v in vocab.items() if k.endswith(suffix)]] = True
        #: Added tokens are found in the text as it is, before its case is lowered.
        self.added = [t["content"].lower() for t in config.get("added_tokens", ())]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.begin, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.single = np.zeros(1, bool)  # one word of the tokenizer

    def _take(self, at: np.ndarray) -> np.ndarray:
        """The ids of known words in a row."""
        n = self.size[at]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.begin[at] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]

    def _keep(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))
        ends = np.concatenate(([0], np.cumsum(self.ends[flat])))
        below = np.cumsum(size)
        self.single = np.concatenate((self.single, ends[below] - ends[below - size] == 1))

    def _each(self, words: list[str]) -> None:
        for k in range(0, len(words), ENCODED):
            some = words[k : k + ENCODED]
            got = [e.ids for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
            self._keep(some, np.array([i for x in got for i in x], dtype=np.uint32), np.array([len(x) for x in got], dtype=np.int64))

    def add(self, words: list[str]) -> None:
        """Learns the ids of words, none of which is known."""
        letters, marked, other = {}, [], []
        for w in words:
            if w.isalpha():
                letters[w] = None
            elif w[-1] in ",." and w[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in self.known:
                    letters[w[:-1]] = None
            else:
                other.append(w)
        new = list(letters)
        for k in range(0, len(new), ENCODED):
            some = new[k : k + ENCODED]
            flat = np.array(self.model.encode(" ".join(some), add_special_tokens=False).ids, dtype=np.uint32)
            last = np.flatnonzero(self.ends[flat])
            if len(last) == len(some):
                self._keep(some, flat, np.diff(last, prepend=-1))
            else:  # letters of which normalisation makes more than letters
                self._each(some)
        if marked:
            self._each([m for m in ",." if m not in self.known and m not in other])
        self._each(other)
        plain = self.single[[self.known[w[:-1]] for w in marked]]
        self._each([w for w, ok in zip(marked, plain) if not ok])
        if pairs := [w for w, ok in zip(marked, plain) if ok]:
            at = np.array([self.known[x] for w in pairs for x in (w[:-1], w[-1])])
            self._keep(pairs, self._take(at), self.size[at].reshape(-1, 2).sum(1))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin and end."""
        texts = pc.fill_null(texts, "")
        if not self.wordwise:
            got = [e.ids for e in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in got for i in x], dtype=np.uint32), np.cumsum([0, *map(len, got)])
        lower = pc.ascii_lower(texts)
        if not any(pc.any(pc.match_substring(lower, t)).as_py() for t in self.added):
            texts = lower
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.clear()
        if new := [w for w in words if w not in self.known]:
            self.add(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        end = np.cumsum(self.size[at])
        # offsets of a sliced list array count from the whole
        edges = lists.offsets.to_numpy()
        return self._take(at), np.concatenate(([0], end))[edges - edges[0]]


#: One for a Python worker, by the file's digest, so that what it knows lasts from task to task.
_ids: dict[str, Ids] = {}


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(from, below) of runs of texts of at most `most` bytes together, or of one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        below = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right"))
        yield at, (below := max(at + 1, below))
        at = below


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, remember: bool = True) -> DataFrame:
    """One row per piece of a document: full windows from its start, then what is left.

    A null text counts as empty and gives one piece of the end id alone. The driver reads the tokenizer's file, of a few
    megabytes, and sends it. With `remember`, a worker keeps the ids of words from task to task; without, it keeps few and
    gives their memory back, for jobs with other stages on the same workers.
    """
    file = Path(tokenizer).read_text(encoding="utf-8")
    name = f"{hashlib.sha256(file.encode()).hexdigest()}-{remember}"
    sent = df.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name not in _ids:
            _ids.clear()
            _ids[name] = Ids(sent.value, CACHE_WORDS if remember else FEW_WORDS)
        ids = _ids[name]
        last = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, below in _slices(batch.column(1), SLICE_BYTES if remember else FEW_BYTES):
                flat, edges = ids.texts(batch.column(1).slice(at, below - at))
                flat, edges = flat.astype("<u4", copy=False), edges.tolist()
                out: list[list] = [[], [], [], [], []]
                for doc, a, b in zip(docs[at:below], edges, edges[1:]):
                    total = b - a + 1
                    for k in range(0, total, window):
                        crc = zlib.crc32(flat[a + k : min(a + k + window, b)])
                        if k + window >= total:
                            crc = zlib.crc32(last, crc)
                        for column, value in zip(out, (doc, k, min(window, total - k), crc, total)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        if not remember:
            del ids
            _ids.clear()
            give_back()

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECE_SCHEMA)


def patterns(counts: dict[int, int], window: int, most: int = PATTERNS) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths at hand that fill the window, exactly where they can, the closest first."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    have = set(lengths.tolist())
    found: dict[tuple[int, ...], int] = {}

    def below(room: int) -> int:
        k = int(np.searchsorted(lengths, room, side="right")) - 1
        return int(lengths[k]) if k >= 0 else 0

    for a in lengths[::-1].tolist():
        if len(found) >= most:
            break
        if a == window:
            found[(a,)] = 0
            continue
        if b := below(window - a):
            found[tuple(sorted((a, b), reverse=True))] = window - a - b
        # partners spread over the shorter lengths, closed by the longest third that fits
        short = lengths[lengths <= (window - a)]
        for b in short[np.unique(np.linspace(0, len(short) - 1, min(len(short), 6)).astype(int))].tolist() if len(short) else []:
            room = window - a - b
            c = room if room in have else below(room)
            if c:
                found[tuple(sorted((a, b, c), reverse=True))] = room - c
    return sorted(found, key=lambda p: (found[p], p))[:most]


def solve(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): least squares for the repeats, rounded down, and best-fit packing of the rest.

    Works on the histogram of lengths alone, which has at most `window` entries whatever the corpus holds.
    The packing of the rest repeats one filling as often as its scarcest length allows, so each step uses
    some length up and there are no more steps than lengths.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if not left:
        return out
    combos = patterns(left, window)
    if combos:
        cols = np.concatenate([np.full(len(p), k) for k, p in enumerate(combos)])
        rows = np.concatenate([np.array(p) for p in combos])
        h = np.zeros(window + 1)
        for k, v in left.items():
            h[k] = v
        x = np.ones(len(combos))
        up = np.bincount(cols, weights=h[rows], minlength=len(combos))
        for _ in range(STEPS):  # multiplicative steps keep every repeat count non-negative
            ax = np.bincount(rows, weights=x[cols], minlength=window + 1)
            x *= up / np.maximum(np.bincount(cols, weights=ax[rows], minlength=len(combos)), 1e-12)
        for k in np.argsort(-x, kind="stable").tolist():
            p = combos[k]
            n = min([int(x[k] + 1e-9), *(left.get(v, 0) // p.count(v) for v in p)])
            if n > 0:
                out.append((p, n))
                for v in p:
                    left[v] -= n
    order = sorted((k for k, v in left.items() if v > 0), reverse=True)
    while order:
        room, fill = window, {}
        for v in order:
            if v <= room:
                fill[v] = min(room // v, left[v])
                room -= v * fill[v]
                if not room:
                    break
        n = min(left[v] // m for v, m in fill.items())
        out.append((tuple(v for v, m in fill.items() for _ in range(m)), n))
        for v, m in fill.items():
            left[v] -= n * m
        order = [v for v in order if left[v] > 0]
    return out


def intervals(solved: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, below rank, copies in a sequence, first sequence, first offset): where ranks of a length go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for p, n in solved:
        offset = 0
        for v in sorted(set(p), reverse=True):
            m = p.count(v)
            at = used.get(v, 0)
            out.append((v, at, at + n * m, m, sequence, offset))
            used[v] = at + n * m
            offset += v * m
        sequence += n
    return out


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, remember: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Pieces of one length are dealt by a hash, document and start; which of two equal rows comes first makes no difference.
    Repeated rows and null ids are packed each by itself. An empty table gives an empty result; other columns, whatever
    their names, are ignored. The driver holds the histogram of lengths (at most `window` rows) and the solved patterns
    (at most PATTERNS + window).
    """
    spark = df.sparkSession
    cutted = cut(pieces(df, tokenizer, id_col, text_col, window, remember), "pieces")
    counts = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    solved = intervals(solve(counts, window))
    # only lengths of many pieces are dealt over several parts, at most `window` of them
    limit = min(MOST_ROWS, max(LEAST_ROWS, sum(counts.values()) // PARTS))
    shares = [(k, -(-n // limit)) for k, n in counts.items() if n > limit]
    split = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in shares for v in kv]), F.col("length").cast("int")), F.lit(1)) if shares else F.lit(1)
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), split)
    dealt = bucketed_rank(cutted.withColumn("_part", part), ["length"], ["_part"], [F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("ids_crc32")], "_rank")
    where = spark.createDataFrame(solved or [(0, 0, 0, 1, 0, 0)], "_len long, _lo long, _hi long, _m long, _seq long, _off long")
    hit = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    nth = F.col("_rank") - F.col("_lo")
    return dealt.join(F.broadcast(where), hit).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_seq") + F.floor(nth / F.col("_m"))).cast("long").alias("sequence_id"),
        (F.col("_off") + F.pmod(nth, F.col("_m")) * F.col("length")).cast("long").alias("offset"),
    )
