"""Token-id files: a corpus's ids in ascending doc_id order, in chunks that an adaptive context-mixing range coder made.

Texts are tokenized where they are read, and only their ids are shuffled, in 16 bits where the vocabulary allows. A pass
over ids, hashes and lengths comes first: it sets the bounds of the parts, ranges of (doc_id, hash of the text, row), so that even
one id with any number of rows is split. Within a part rows are sorted, cut into chunks of whole documents and coded (see
range_coder.py); chunks are the binary column of a Parquet dataset, so that Spark's committer keeps a lost executor or a
repeated task from spoiling it. Columns: part and chunk (the order), start_in_part and n_ids, doc_ids and doc_lens
(documents in the chunk), payload.

Defined results: a null text is empty and has the end id alone; a null doc_id comes first; repeated rows are written each, in
order of a hash of their text; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm import range_coder, tokens
from memloom.llm.common import cut

#: Ids that a chunk holds, before its last document; bytes of text meant for a part.
CHUNK, PART = 1 << 22, 32 << 20


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumns({"_mark": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})


def _key(doc_id, mark: int, row: int) -> tuple:
    return (doc_id is not None, doc_id, mark, row) if doc_id is not None else (False, mark, row)


def bounds(docs: DataFrame, part: int = PART) -> list[tuple]:
    """The first keys of all parts but the first, which has the same bytes of text as each other, up to a document: from every row's key and length.

    Keys and lengths, without texts, are ordered by range; each partition's total is one row, and only the keys of rows that
    a part begins with leave their task.
    """
    import pyarrow as pa

    keys = ("doc_id", "_mark", "_row")
    sized = cut(_keyed(docs).select(*keys, (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")))
    total, n = sized.agg(F.sum("size"), F.count("*")).head()
    parts = -(-((total or 0) - n) // part)
    if parts < 2:
        return []
    ordered = cut(sized.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_p", F.spark_partition_id())
    sums = sorted(map(tuple, ordered.groupBy("_p").agg(F.sum("size")).collect()))
    before = dict(zip([p for p, _ in sums], np.cumsum([0, *(s for _, s in sums)]).tolist(), strict=False))

    def firsts(batches):
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("size").to_numpy()
            end = (before[b.column("_p")[0].as_py()] if at is None else at) + np.cumsum(size)
            at = int(end[-1])
            begins = (end - 1) * parts // total > np.maximum(end - size - 1, 0) * parts // total
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(begins)) for c in keys], list(keys))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sorted(_key(*r) for r in ordered.mapInArrow(firsts, f"doc_id {kind}, _mark long, _row long").collect())


def write(docs: DataFrame, path: str, tokenizer: str | None = None, chunk: int = CHUNK, part: int = PART) -> None:
    """Writes the ids of every whole text, each followed by the end id, to path."""
    import pyarrow as pa

    vocabulary = tokenizer or tokens.default_path()
    first = bounds(docs, part)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenize(batches):
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("doc_id", "_mark", "_row")), strict=True)
            parts = [bisect_right(first, _key(*k)) for k in keys]
            rows, widths, held, at = [], [], 0, 0
            for raw in tokens.encoder(vocabulary).encode(b.column("text")):
                ids = np.frombuffer(raw, "<u4")
                narrow = not int(ids.max()) >> 16
                rows.append(ids.astype("<u2").tobytes() if narrow else raw)
                widths.append(2 if narrow else 4)
                held += len(rows[-1])
                if held > 1 << 24 or at + len(rows) == b.num_rows:
                    some = slice(at, at + len(rows))
                    cols = [pa.array(parts[some], pa.int32()), *(b.column(c)[some] for c in ("doc_id", "_mark", "_row")), pa.array(widths, pa.int32()), pa.array(rows, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "_mark", "_row", "width", "ids"])
                    at += len(rows)
                    rows, widths, held = [], [], 0

    def code(batches):
        now, number, start, held, like = None, 0, 0, 0, None
        doc_ids: list = []
        parts: list[np.ndarray] = []

        def row():
            nonlocal number, start, held
            coded = range_coder.encode(np.concatenate(parts).astype("<u4"))
            cols = [[now], [number], [start], [held], [doc_ids], [[len(p) for p in parts]], [coded]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(like), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "chunk", "start_in_part", "n_ids", "doc_ids", "doc_lens", "payload"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            number, start, held = number + 1, start + held, 0
            doc_ids.clear()
            parts.clear()
            return out

        for b in batches:
            like = b.schema.field("doc_id").type
            for part, doc_id, width, raw in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "width", "ids")), strict=True):
                if part != now:
                    if parts:
                        yield row()
                    now, number, start = part, 0, 0
                doc_ids.append(doc_id)
                parts.append(np.frombuffer(raw, f"<u{width}"))
                held += len(parts[-1])
                if held >= chunk:
                    yield row()
        if parts:
            yield row()

    coded = _keyed(docs).mapInArrow(tokenize, f"part int, doc_id {kind}, _mark long, _row long, width int, ids binary")
    ordered = coded.repartitionById(len(first) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "_mark", "_row").drop("_mark", "_row")
    ordered.mapInArrow(code, f"part int, chunk int, start_in_part long, n_ids long, doc_ids array<{kind}>, doc_lens array<long>, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it in the whole corpus), n_tokens, ids_crc32 and, if asked for, ids, from the files at path.

    The running total over parts has a row for each part.
    """
    import pyarrow as pa

    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    placed = files.join(before, "part").select((F.col("before") + F.col("start_in_part")).alias("start"), "doc_ids", "doc_lens", "payload")

    def decode(batches):
        for b in batches:
            item = b.schema.field("doc_ids").type.value_type
            for r in range(b.num_rows):
                ids = range_coder.decode(b.column("payload")[r].as_py())
                lens = np.array(b.column("doc_lens")[r].as_py(), np.int64)
                ends = np.cumsum(lens)
                raw = [ids[e - n : e] for e, n in zip(ends, lens, strict=True)]
                cols = [pa.array(b.column("doc_ids")[r].as_py(), item), pa.array(b.column("start")[r].as_py() + ends - lens), pa.array(lens), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.tobytes() for x in raw], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return placed.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
