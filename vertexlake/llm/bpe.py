"""Byte-level BPE encoding of a whole text column.

The text is cut into pre-tokens by array operations. In each Python task the pre-tokens not seen before are laid end to end as one linked list of symbols, and merged by a rank queue: one bucket of list positions for each
merge rank, and a hierarchical bitmap of the non-empty buckets whose find-first-set gives the next rank. A bucket is
taken as a whole (all of its positions, in array operations); entries whose pair has changed since are stale and
skipped. The cost is in proportion to the merges made, however long a pre-token is.

Cases: a null text and an empty text give no ids (an empty list); a blank text gives the ids of its white space;
special-token strings in a text are ordinary text. Rows are neither dropped nor joined, so repeated ids stay.
"""

from __future__ import annotations

import itertools
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexlake.llm.pretokens import class_table, pretokens

#: Where the public vocabulary file lies unless another path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-tokens kept in a Python worker (about 200 bytes each); beyond that the store starts afresh.
KEPT = 300_000
#: Symbols laid out in one list at a time, and bytes of text cut at a time.
AT_ONCE, CUT = 1_000_000, 2_000_000


def _byte_names() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> dict[str, np.ndarray]:
    """`first`: the id of each byte; `keys`: left id * 65536 + right id, ascending, with `ranks` and `made` beside it."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    first = np.zeros(256, np.int32)
    for ch, b in _byte_names().items():
        first[b] = vocab[ch]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([vocab[a] * 65536 + vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys, kind="stable")
    return {"first": first, "keys": keys[order], "ranks": order.astype(np.int32), "made": made}


class RankBitmap:
    """The set of non-empty buckets: words of 64 bits in three levels, the lowest member found by find-first-set."""

    def __init__(self) -> None:
        self.low, self.mid, self.top = [0] * 4096, [0] * 64, 0

    def add(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> int:
        """The lowest rank, taken out; -1 if there is none."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        w = self.mid[b]
        a = (b << 6) + (w & -w).bit_length() - 1
        w = self.low[a]
        bit = w & -w
        self.low[a] = w ^ bit
        if not self.low[a]:
            self.mid[b] ^= 1 << (a & 63)
            if not self.mid[b]:
                self.top ^= 1 << b
        return (a << 6) + bit.bit_length() - 1


class Encoder:
    """Pre-tokens to ids, with a store of those already merged."""

    def __init__(self, v: dict[str, np.ndarray]) -> None:
        self.first, self.keys, self.rank_of, self.made = v["first"], v["keys"], v["ranks"], v["made"]
        self.pair_of = np.empty(len(self.keys), np.int64)
        self.pair_of[self.rank_of] = self.keys
        self.table = v["classes"]
        self.forget()

    def forget(self) -> None:
        """Empty the store: a number for each pre-token met, and the ids of all of them end to end."""
        self.number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left.astype(np.int64) * 65536 + right
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.rank_of[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and where each piece starts among them (one more than pieces)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(pieces) else 0
        sym = np.append(self.first[np.frombuffer(b"".join(pieces), np.uint8)], np.int32(-1))
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends[sizes > 0] - 1] = n
        prv[(ends - sizes)[sizes > 0]] = n
        rank = np.full(n + 1, -1, np.int64)
        at = np.nonzero(nxt[:n] != n)[0]
        rank[at] = self._ranks(sym[at], sym[at + 1])
        at = at[rank[at] >= 0]
        at = at[np.argsort(rank[at], kind="stable")]
        queue, laid, pushed = RankBitmap(), {}, {}
        held, starts = np.unique(rank[at], return_index=True)
        for r, a, b in zip(held.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
            laid[r] = at[a:b]
            queue.add(r)
        alive = np.ones(n, bool)
        while (r := queue.pop()) >= 0:
            i = laid.pop(r, None)
            if (late := pushed.pop(r, None)) is not None:
                late = np.array(late, np.int64)
                i = np.unique(late if i is None else np.concatenate([i, late]))
            i = i[rank[i] == r]  # the others are stale
            if not len(i):
                continue
            pair = int(self.pair_of[r])
            if len(i) > 1 and pair >> 16 == pair & 65535:  # a run of one symbol merges in twos from the left
                start = np.append(True, nxt[i[:-1]] != i[1:])
                k = np.arange(len(i))
                i = i[(k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0]
            j = nxt[i]
            k = nxt[j]
            sym[i] = self.made[r]
            nxt[i] = k
            prv[k] = i
            alive[j] = False
            rank[j] = -1
            h = prv[i]
            pos = np.concatenate([i, h[h != n]])
            right = nxt[pos]
            new = np.where(right == n, -1, self._ranks(sym[pos], sym[right]))
            rank[pos] = new
            for q, p in zip(new.tolist(), pos.tolist()):
                if q >= 0:
                    if q in pushed:
                        pushed[q].append(p)
                    else:
                        pushed[q] = [p]
                        queue.add(q)
            rank[n] = -1
            prv[n] = n
        owner = np.repeat(np.arange(len(pieces)), sizes)[alive]
        return sym[:n][alive], np.append(0, np.cumsum(np.bincount(owner, minlength=len(pieces))))

    def learn(self) -> None:
        """Merge the pre-tokens that have a number but no ids yet."""
        new = list(itertools.islice(self.number, len(self.starts) - 1, None))
        ids, starts = [self.ids], [self.starts]
        while new:
            sizes = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
            n = max(1, int(np.searchsorted(sizes, AT_ONCE)))
            got, at = self.merge([p.encode() for p in new[:n]])
            ids.append(got)
            starts.append(at[1:] + starts[-1][-1])
            new = new[n:]
        self.ids, self.starts = np.concatenate(ids), np.concatenate(starts)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pre-tokens end to end, and where each text starts among them."""
        if len(self.number) > KEPT:
            self.forget()
        codes, sizes, a = [], [], 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while a < len(texts):  # a slice of whole texts
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CUT, "right")))
            pieces, n = pretokens(texts.slice(a, z - a), self.table)
            distinct = pieces.dictionary_encode()
            known = np.fromiter(map(self.number.__getitem__, distinct.dictionary.to_pylist()), np.int32)
            codes.append(known[distinct.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int32))
            sizes.append(n)
            a = z
        self.learn()
        none = [np.zeros(0, np.int64)]
        return np.concatenate(codes or none), np.append(0, np.cumsum(np.concatenate(sizes or none)))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        codes, starts = self.numbers(texts)
        total = np.append(0, np.cumsum(np.diff(self.starts)[codes]))
        return np.diff(total[starts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text starts among them."""
        codes, starts = self.numbers(texts)
        sizes = np.diff(self.starts)[codes]
        total = np.append(0, np.cumsum(sizes))
        out = np.empty(total[-1], np.int32)
        for a in range(0, len(codes), 1_000_000):
            c, n = codes[a : a + 1_000_000], sizes[a : a + 1_000_000]
            z = total[a + len(c)]
            out[total[a] : z] = self.ids[np.repeat(self.starts[c] - total[a : a + len(c)], n) + np.arange(total[a], z)]
        return out, total[starts]


_encoders: dict[int, Encoder] = {}


def _encoder(v) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; it lives as long as the worker."""
    if v.id_ not in _encoders:
        _encoders.clear()
        _encoders[v.id_] = Encoder(v.value)
    return _encoders[v.id_]


class _Vocabulary:
    """A broadcast vocabulary (about 50,000 merges, under 3 MB with the classes of the code points: fixed files, not data) with an id for the workers."""

    def __init__(self, spark, path: str) -> None:
        value = read_vocabulary(path) | {"classes": class_table()}
        self.handle = spark.sparkContext.broadcast(value)
        self.id_ = hash((path, len(value["keys"]), int(value["keys"].sum())))

    @property
    def value(self) -> dict[str, np.ndarray]:
        return self.handle.value


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = VOCABULARY, out: str = "ids") -> DataFrame:
    """The columns `keep` (all but the text, if not given) and `out`, the text's ids as array<int>, row by row."""
    keep = [c for c in df.columns if c not in (text, out)] if keep is None else keep
    v = _Vocabulary(df.sparkSession, path)
    own = "text_" + "_" * max(map(len, keep), default=0)  # a name no other column has
    rows = df.select(*keep, F.col(text).alias(own))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{out}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(v)
        for b in batches:
            ids, starts = e.encode(b.column(own))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], [*keep, out])

    return rows.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """As `encode`, with the number of ids (0 for a null text) in place of the ids."""
    keep = [c for c in df.columns if c not in (text, out)] if keep is None else keep
    v = _Vocabulary(df.sparkSession, path)
    own = "text_" + "_" * max(map(len, keep), default=0)  # a name no other column has
    rows = df.select(*keep, F.col(text).alias(own))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(v)
        for b in batches:
            n = pa.array(e.counts(b.column(own)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], [*keep, out])

    return rows.mapInArrow(run, schema)
