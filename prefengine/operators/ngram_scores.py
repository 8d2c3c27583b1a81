"""Scoring texts by n-gram counts without moving the places of an n-gram one by one.

A task asks once for each n-gram (or context) of a chunk of its texts; with the question go the rows of the chunk that hold it, two
bytes a place.  Spark joins the questions with the counts.  What is found goes back to the chunk in compressed blocks: the rows
of equal counts together or, where that is less, the sums of the rows.  Frequent n-grams are held by every task and
never asked for.  The disk that this takes grows with the n-grams of the texts, whatever the number of partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from prefengine.operators.ngram_counts import BATCH_ROWS, chunks, hashes, places, release

#: Rows of a chunk: their numbers take two bytes.
ROWS = 1 << 16
#: Bytes of found questions that a task packs at once.
PACK_BYTES = 32 << 20
#: About the bytes of a place in a block.
PLACE_BYTES = 1.5
#: What a block holds: the chunk's own rows, places by their counts, or sums of rows.
OWN, PLACES, SUMS = 0, 1, 2


def chunk_sums(df: DataFrame, key: list[str], col: str, counts: DataFrame, on: list[str], hot: DataFrame, names: tuple[str, ...],
               adds: list[float], n: int, start: str, few: bool, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """(key..., _m, names...): per row of ``df`` its number of tokens and the sums of ln(count + add) of its n-grams (``on`` ctx and
    tok) or of their contexts (``on`` ctx).

    ``counts`` has c_<name>... by the xxhash64 of ``on`` (unique), ``hot`` some of its rows that each task may hold.  With ``few`` a
    task can hold its share of the questions.  ``turn`` (i, of): only what falls to it, a share of the keys; all turns add up."""
    columns = [f"c_{name}" for name in names]
    texts = df.select(*key, F.lower(col).alias("_text"))
    held = df.sparkSession.sparkContext.broadcast(_Hot(hot.select(*on, *columns).toArrow(), on, columns, adds))
    whole = [*on, "chunk", "data"]
    asks = texts.mapInArrow(_asker(key, names, n, start, on, held, turn), ", ".join(f"{c} {'binary' if c == 'data' else 'long'}" for c in whole))
    met = (asks.hint("shuffle_hash") if few else asks).join(counts.select(*on, *columns), on, "left").select("chunk", "data", *columns)
    blocks = met.mapInArrow(_packer(columns, adds), "chunk long, kind int, n int, data binary")
    out = StructType([*df.select(*key).schema.fields, StructField("_m", LongType()), *[StructField(name, DoubleType()) for name in names]])
    return blocks.repartition("chunk").mapInArrow(_summer(key, names, adds), out)


def _logs(counts: np.ndarray, adds: list[float]) -> np.ndarray:
    return np.log(counts + np.array(adds))


class _Hot:
    """The hot keys and ln(count + add) of each model."""

    def __init__(self, rows: pa.Table, on: list[str], columns: list[str], adds: list[float]):
        keys = [rows.column(c).to_numpy() for c in on]
        self.words = [np.unique(k) for k in keys]
        code = np.zeros(len(rows), np.int64)
        for words, k in zip(self.words, keys):
            code = code * max(1, len(words)) + np.searchsorted(words, k)
        order = np.argsort(code)
        self.codes = code[order]
        self.logs = _logs(np.stack([rows.column(c).to_numpy() for c in columns], 1)[order], adds)

    def find(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each key, -1 for others; a side is the hashes of its words and every key's word."""
        code, known = 0, True
        for words, (words_hash, word) in zip(self.words, sides):
            at, has = _search(words, words_hash)
            code, known = code * max(1, len(words)) + at[word], known & has[word]
        at, has = _search(self.codes, code)
        return np.where(known & has, at, -1)


def _search(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(held):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return at, held[at] == keys


def _asker(key: list[str], names: tuple[str, ...], n: int, start: str, on: list[str], held,
           turn: tuple[int, int]) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()  # a task that is run anew may get its rows in another order
        for i, texts in enumerate(chunks(batches, ROWS)):
            yield from _asks(texts, key, names, n, start, on, held.value, attempt << 24 | i, turn)
            del texts
    return ask


def _asks(texts: pa.Table, key: list[str], names: tuple[str, ...], n: int, start: str, on: list[str], hot: _Hot,
          chunk: int, turn: tuple[int, int] = (0, 1)) -> Iterator[pa.RecordBatch]:
    """The questions of a chunk, and its own rows: keys, tokens, those not asked for, and the sums of these."""
    words, ids, row, ctx_words, ctx = places(texts.column("_text"), n, start)
    size = len(texts)
    gram = ctx if len(on) == 1 else ctx * len(words) + ids
    del ctx, ids
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order].astype(np.int32)
    del order
    begin = np.flatnonzero(np.diff(gram, prepend=-1))
    times, gram = np.diff(begin, append=len(gram)), gram[begin]
    del begin
    tok_hash = hashes(words) if len(on) == 2 or ctx_words is words else None
    sides = [(tok_hash if ctx_words is words else hashes(ctx_words), gram if len(on) == 1 else gram // len(words))]
    if len(on) == 2:
        sides.append((tok_hash, gram % len(words)))
    at = hot.find(sides)
    cold = at < 0
    if turn[1] > 1:
        mine = np.zeros(len(gram), np.uint64)
        for words_hash, word in sides:
            mine = mine * np.uint64(31) + words_hash[word].view(np.uint64)
        cold &= (mine >> np.uint64(7)) % np.uint64(turn[1]) == turn[0]
        del mine
    known = (at >= 0) & (turn[0] == 0)
    rare, often = np.repeat(cold, times), np.repeat(known, times)
    own = {c: texts.column(c).combine_chunks() for c in key} | {
        "_m": np.bincount(row, minlength=size) * (turn[0] == 0), "_cold": np.bincount(row[rare], minlength=size)}
    log = np.repeat(at[known], times[known])
    own |= {f"_s{i}": np.bincount(row[often], hot.logs[log, i], size) for i in range(len(names))}
    yield _asked(on, [np.array([chunk * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64).view(np.int64)] * len(on), ~chunk, pa.array([_stream(pa.table(own))], pa.binary()))
    asked = [words_hash[word[cold]] for words_hash, word in sides]
    del sides, gram, at, known, often, log
    rows = pa.py_buffer(row[rare].astype("<u2").tobytes())
    ends = np.concatenate([[0], np.cumsum(times[cold]) * 2]).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), rows])
    for i in range(0, len(data), BATCH_ROWS):
        yield _asked(on, [x[i:i + BATCH_ROWS] for x in asked], chunk, data.slice(i, BATCH_ROWS))


def _asked(on: list[str], keys: list[np.ndarray], chunk: int, data: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(k) for k in keys], pa.array(np.full(len(data), chunk)), data], [*on, "chunk", "data"])


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _packer(columns: list[str], adds: list[float]) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            own = batch.filter(pa.array(chunk < 0))
            if own.num_rows:
                yield _blocks([(~c.as_py(), OWN, 0, d.as_py()) for c, d in zip(own.column("chunk"), own.column("data"))])
            held.append(batch.filter(pa.array(chunk >= 0)) if own.num_rows else batch)
            size += held[-1].nbytes
            if size >= PACK_BYTES:
                yield _blocks(_packed(pa.Table.from_batches(held), columns, adds))
                held, size = [], 0
                release()
        if held:
            yield _blocks(_packed(pa.Table.from_batches(held), columns, adds))
        del held
        release()
    return pack


def _blocks(rows) -> pa.RecordBatch:
    rows = list(rows)
    kinds = {"chunk": pa.int64(), "kind": pa.int32(), "n": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def _packed(met: pa.Table, columns: list[str], adds: list[float]) -> Iterator[tuple[int, int, int, bytes]]:
    """A block per chunk: its places sorted by their counts, then by row."""
    if not len(met):
        return
    counts = np.stack([met.column(c).fill_null(0).to_numpy() for c in columns], 1)
    chunk = met.column("chunk").to_numpy()
    order = np.lexsort((*counts.T, chunk))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(chunk[order]) != 0) | (np.diff(counts[order], axis=0) != 0).any(1)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    chunk, counts = chunk[order][first], counts[order][first]
    found = np.concatenate([_rows(part) for part in met.column("data").chunks])
    times = np.concatenate([np.diff(_ends(part)) // 2 for part in met.column("data").chunks])
    # a place is its group and its row
    place = np.sort(np.repeat(group, times) << 16 | found)
    group, row = place >> 16, place & ROWS - 1
    ends = np.searchsorted(group, np.flatnonzero(np.diff(chunk, append=-1)), side="right")
    for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        rows, groups = row[begin:end], group[begin:end]
        start = np.flatnonzero(np.diff(groups, prepend=-1))
        sizes, own = np.diff(start, append=len(groups)), counts[groups[start]]
        top = int(rows.max()) + 1
        if (end - begin) * PLACE_BYTES > top * (8 * len(columns) + 1):
            logs = np.repeat(_logs(own, adds), sizes, 0)
            parts = [np.bincount(rows, minlength=top).astype(np.int64), *[np.bincount(rows, logs[:, i], top) for i in range(len(columns))]]
            kind, n = SUMS, top
        else:
            step = np.diff(rows, prepend=0)
            step[start] = rows[start]
            parts = [sizes, *own.T, step.astype("<u2")]
            kind, n = PLACES, len(sizes)
        raw = b"".join(p.tobytes() for p in parts)
        yield int(chunk[groups[0]]), kind, n, len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _ends(data: pa.Array) -> np.ndarray:
    return np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1]


def _rows(data: pa.Array) -> np.ndarray:
    ends = _ends(data)
    return np.frombuffer(data.buffers()[2], "<u2")[ends[0] // 2:ends[-1] // 2].astype(np.int64)


def _unpacked(kind: int, n: int, data: bytes, adds: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) of the first rows of a chunk."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    if kind == SUMS:
        return np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.float64, offset=8 * n).reshape(len(adds), n)
    sizes = np.frombuffer(raw, np.int64, n)
    logs = _logs(np.frombuffer(raw, np.int64, n * len(adds), 8 * n).reshape(len(adds), n).T, adds)
    rows = np.cumsum(np.frombuffer(raw, "<u2", offset=8 * n * (1 + len(adds))).astype(np.int64))
    before = np.cumsum(sizes) - sizes
    rows -= np.repeat(np.where(before > 0, rows[before - 1], 0), sizes)
    return np.bincount(rows), np.stack([np.bincount(rows, np.repeat(logs[:, i], sizes)) for i in range(len(adds))])


def _summer(key: list[str], names: tuple[str, ...], adds: list[float]) -> Callable:
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, bytes] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, kind, n, data in zip(*[batch.column(c).to_pylist() for c in ("chunk", "kind", "n")], batch.column("data")):
                if kind == OWN:
                    own[chunk] = data.as_py()
                    continue
                some = np.vstack(_unpacked(kind, n, data.as_py(), adds))
                held = sums.get(chunk, some[:, :0])
                if held.shape[1] < some.shape[1]:
                    held = np.pad(held, ((0, 0), (0, some.shape[1] - held.shape[1])))
                held[:, :some.shape[1]] += some
                sums[chunk] = held
        if sums.keys() - own.keys():
            raise ValueError("ngram_logps: the rows of a chunk are missing")
        for chunk, data in own.items():
            rows = pa.ipc.open_stream(data).read_all().combine_chunks()
            held = np.zeros((1 + len(names), len(rows)))
            some = sums.pop(chunk, held[:, :0])
            held[:, :some.shape[1]] = some
            if not np.array_equal(held[0], rows.column("_cold").to_numpy()):
                raise ValueError("ngram_logps: places of a chunk are missing")
            values = {name: pa.array(rows.column(f"_s{i}").to_numpy() + held[1 + i]) for i, name in enumerate(names)}
            yield from pa.table({c: rows.column(c) for c in (*key, "_m")} | values).to_batches(BATCH_ROWS)
    return total
