"""Counting n-grams: a task turns its texts into counts with Arrow and numpy, Spark deals them by n-gram, a
task of the other side adds them up.

An n-gram, its context and its token are counted in one pass (as GROUPING SETS would, without a row per
place).  An n-gram is the pair of the XXH64 hashes of its context and its token (Spark's ``xxhash64``), so the many
rare ones move as numbers, in blocks of a part each.  Contexts and tokens keep their strings, and two of them with one hash raise."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.session import plan_bytes

#: Bytes of text that a task counts at once, and rows that it adds up at once.
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 19
#: Bytes of blocks, and rows, of a batch that goes back to Spark.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1 << 16
#: Bytes of input files behind one part of the counts.
PART_BYTES = 8 << 20
#: What a row counts; a block of words has their counts as contexts and as tokens.
CONTEXT, TOKEN, NGRAM, WORD = 0, 1, 2, 3
#: The seed of Spark's ``xxhash64``.
SEED = 42


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Give freed memory back to the machine: a Python worker keeps it for its next task, beside what Arrow's pool keeps."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def count_parts(parts: list[DataFrame]) -> int:
    """Parts for the counts of these texts: by their size, at least the session's shuffle partitions."""
    size = sum(plan_bytes(df) or 0 for df in parts)
    return max(int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def count_ngrams(texts: DataFrame, names: tuple[str, ...], n: int, start: str, parts: int) -> DataFrame:
    """(ctx, tok, word, c_<name>..., c_all, kind) with one row per n-gram (no word), context (its string is the word, no
    tok) and token (its string is the word, no ctx) of ``texts``, columns ``text`` (lower case) and ``models`` (bit i: the
    row belongs to model i); hash-partitioned by (ctx, tok) into ``parts``."""
    columns = [f"c_{name}" for name in (*names, "all")]
    blocks = texts.select("text", "models").mapInArrow(_counter(len(names), n, start, columns, parts), "part int, kind int, data binary")
    schema = "ctx long, tok long, word string, " + ", ".join(f"`{c}` long" for c in columns) + ", kind int"
    return blocks.repartitionById(parts, F.col("part")).mapInArrow(_adder(columns), schema)


def _counter(models: int, n: int, start: str, columns: list[str], parts: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches):
            yield from _blocks(_counts(texts, models, n, start, columns), parts)
            del texts  # with the batches that it is cut from
    return count


def chunks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """The rows in order, CHUNK_BYTES at a time, and ``most`` rows at most."""
    release()  # what earlier tasks of this worker left
    held, size, rows = [], 0, 0
    for batch in batches:
        step = max(1, batch.num_rows * CHUNK_BYTES // max(1, batch.nbytes))
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, min(step, most - rows) if most else step))
            at += held[-1].num_rows
            size += held[-1].nbytes
            rows += held[-1].num_rows
            if size >= CHUNK_BYTES or rows == most:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
                release()
    if held:
        yield pa.Table.from_batches(held)
    del held
    release()


def _counts(texts: pa.Table, models: int, n: int, start: str, columns: list[str]) -> Iterator[tuple[int, pa.Table]]:
    """The counts of one chunk, a table per kind: one sort of its n-grams, as numbers of its own words."""
    words, ids, row, ctx_words, ctx = places(texts.column("text"), n, start)
    if not len(ids):
        return
    bits = texts.column("models").to_numpy()
    masks, member = np.unique(bits, return_inverse=True)
    ctx *= len(words)
    ctx += ids
    ctx *= len(masks)
    ctx += member[row]
    del ids, row  # a chunk's arrays are large: each goes when it has been used
    ctx.sort()
    begin = np.flatnonzero(np.diff(ctx, prepend=-1))
    times, found = np.diff(begin, append=len(ctx)), ctx[begin]
    del ctx, begin
    grams, mask = np.divmod(found, len(masks))
    mask = masks[mask]
    # the masks of an n-gram stand side by side
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    sums = [np.add.reduceat(times * (mask >> i & 1), first) for i in range(models)] + [np.add.reduceat(times, first)]
    grams = grams[first]
    del found, times, mask, first
    ctx, tok = np.divmod(grams, len(words))
    del grams
    tok_hash = hashes(words)
    ctx_hash = tok_hash if ctx_words is words else hashes(ctx_words)
    begin = np.flatnonzero(np.diff(ctx, prepend=-1))
    one, ctx_sums = ctx[begin], [np.add.reduceat(s, begin) for s in sums]
    order = np.argsort(tok, kind="stable")
    begin = np.flatnonzero(np.diff(tok[order], prepend=-1))
    two, tok_sums = tok[order][begin], [np.add.reduceat(s[order], begin) for s in sums]
    if ctx_words is words:
        yield WORD, _table([*columns, *_as_token(columns)], [*[_spread(s, one, words) for s in ctx_sums], *[_spread(s, two, words) for s in tok_sums]],
                           ctx=tok_hash, word=words)
    else:
        yield CONTEXT, _table(columns, ctx_sums, ctx=ctx_hash[one], word=ctx_words.take(pa.array(one)))
        yield TOKEN, _table(columns, tok_sums, tok=tok_hash[two], word=words.take(pa.array(two)))
    del order, begin, one, two, ctx_sums, tok_sums
    keys = {"ctx": ctx_hash[ctx], "tok": tok_hash[tok]}
    del ctx, tok, words, ctx_words
    yield NGRAM, _table(columns, sums, **keys)


def _as_token(columns: list[str]) -> list[str]:
    return [f"t{c}" for c in columns]


def _spread(sums: np.ndarray, at: np.ndarray, words: pa.Array) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    out[at] = sums
    return out


def _table(columns: list[str], sums: list[np.ndarray], **keys) -> pa.Table:
    return pa.table(keys | {c: pa.array(s, pa.int64()) for c, s in zip(columns, sums)})


def _blocks(tables: Iterator[tuple[int, pa.Table]], parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of each part as one block of compressed Arrow bytes: Spark moves blocks, not rows."""
    packed = pa.ipc.IpcWriteOptions(compression="zstd")
    for kind, table in tables:
        part = _part([table.column(c).to_numpy() for c in ("ctx", "tok") if c in table.column_names], parts).astype(np.int32)
        order = np.argsort(part, kind="stable")
        table = (table.drop_columns("ctx") if kind == WORD else table).take(pa.array(order)).combine_chunks()  # a word's hash is found again
        part = part[order]
        del order
        ends = np.flatnonzero(np.diff(part, append=np.int32(-1))) + 1
        held, size, begin = [], 0, 0
        for end in ends.tolist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=packed) as out:
                out.write_table(table.slice(begin, end - begin))
            held.append((int(part[begin]), kind, sink.getvalue().to_pybytes()))
            size += len(held[-1][2])
            begin = end
            if size >= BATCH_BYTES or end == ends[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.int32(), pa.int32(), pa.binary()))],
                                                 ["part", "kind", "data"])
                held, size = [], 0


def _part(keys: list[np.ndarray], parts: int) -> np.ndarray:
    """The bucket of each key, by Spark's ``hash`` (Murmur3 of longs).  Only how many files a bucket has depends on it."""
    def mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = h ^ k
        return (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h = np.full(len(keys[0]), SEED, np.uint32)
    for key in keys:
        low, high = (key.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        h = mixed(mixed(h, low), high) ^ np.uint32(8)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        h = h ^ h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % parts


def hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words)).view(np.int64)


def places(texts: pa.ChunkedArray, n: int, start: str) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The distinct words and contexts (their strings) and of every token its word, its row and its context."""
    words, ids, row, place = _tokens(texts, start)
    release()
    ctx_words, ctx = words, np.zeros(len(ids), np.int64)  # words[0] is ``start``
    if n == 1:
        ctx_words = pa.array([""])
    for back in range(n - 1, 0, -1):
        shifted = np.concatenate([np.zeros(back, np.int64), ids])[:len(ids)]
        shifted[place < back] = 0
        if back == n - 1:
            ctx = shifted
            continue
        found, ctx = np.unique(ctx * len(words) + shifted, return_inverse=True)
        ctx_words = pc.binary_join_element_wise(ctx_words.take(pa.array(found // len(words))), words.take(pa.array(found % len(words))), " ")
    return words, ids, row, ctx_words, ctx


def _tokens(texts: pa.ChunkedArray, start: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words (``start`` first) and of every token its word, its row and its place in the row: white space
    as in ``token_list``, blanks removed."""
    lists = pa.chunked_array([pc.ascii_split_whitespace(c) for c in texts.chunks]).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    del lists
    full = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(lengths)), lengths)[full.to_numpy(zero_copy_only=False)]
    flat = flat.filter(full)
    coded = pa.chunked_array([pa.array([start], flat.type), flat]).dictionary_encode().unify_dictionaries()
    del flat, full
    ids = coded.chunk(1).indices.to_numpy().astype(np.int64)
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(begin, np.diff(begin, append=len(row)))
    return coded.chunk(1).dictionary, ids, row, place


def _adder(columns: list[str]) -> Callable:
    def add(rows: pa.Table, keys: list[str]) -> pa.Table:
        counts = [c for c in rows.column_names if c not in keys]
        sums = rows.group_by(keys, use_threads=False).aggregate([(c, "sum") for c in counts])
        return sums.select([*keys, *[f"{c}_sum" for c in counts]]).rename_columns([*keys, *counts])

    def given(kind: int, sums: pa.Table) -> Iterator[pa.RecordBatch]:
        n = sums.num_rows
        own = {c: sums.column(c) for c in sums.column_names}
        empty = {"ctx": pa.nulls(n, pa.int64()), "tok": pa.nulls(n, pa.int64()), "word": pa.nulls(n, pa.string())}
        yield from pa.table(empty | own | {"kind": pa.array(np.full(n, kind, np.int32))}).to_batches(BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        keys = {CONTEXT: ["ctx", "word"], TOKEN: ["tok", "word"], NGRAM: ["ctx", "tok"], WORD: ["word"]}
        held: dict[int, list] = {kind: [] for kind in keys}
        fresh = dict.fromkeys(held, 0)
        done = dict.fromkeys(held, 0)
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
                held[kind].append(pa.ipc.open_stream(data.as_buffer()).read_all())
                fresh[kind] += held[kind][-1].num_rows
                if fresh[kind] >= max(CHUNK_ROWS, done[kind]):
                    held[kind] = [add(pa.concat_tables(held[kind]), keys[kind])]
                    fresh[kind], done[kind] = 0, held[kind][0].num_rows
        for kind, parts in held.items():
            if not parts:
                continue
            sums = add(pa.concat_tables(parts), keys[kind])
            parts.clear()
            if kind == NGRAM:  # side by side, the n-grams of a context take less in a file
                sums = sums.take(pa.array(np.argsort(sums.column("ctx").to_numpy())))
                release()
                yield from given(kind, sums)
                continue
            word_hash = pa.array(hashes(sums.column("word").combine_chunks())) if kind == WORD else sums.column(keys[kind][0])
            if pc.count_distinct(word_hash).as_py() < sums.num_rows:
                raise ValueError("count_ngrams: two words have one hash")
            if kind != WORD:
                yield from given(kind, sums)
                continue
            for one, key, counts in ((CONTEXT, "ctx", columns), (TOKEN, "tok", _as_token(columns))):
                some = pa.table({key: word_hash, "word": sums.column("word")} | {c: sums.column(x) for c, x in zip(columns, counts)})
                yield from given(one, some.filter(pc.greater(some.column(columns[-1]), 0)))
        sums = word_hash = some = None
        release()
    return run
