"""What the text operators share: Arrow-batched scalar functions, frequent-unit counts, broadcast bounds."""

from __future__ import annotations

import gc
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.session import ensure_checkpoint_dir, settled, table  # noqa: F401  (re-exported)

#: Bytes that a broadcast value may have before an operator takes its other way.
BROADCAST_BYTES = 64 << 20

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts_udf(per_text: Callable[[str], tuple], ddl: str, fields: dict[str, pa.DataType]) -> Callable[[Column], Column]:
    """A scalar function over a string column that yields a struct, fed by Arrow batches.

    per_text gets each text (null as the empty string) and returns the struct's values in order. The
    other columns of the row never leave the JVM, so inputs may carry any further columns. Marked
    nondeterministic only because the optimiser would run it twice where a filter and a projection read its result; filters on
    other columns stay above it for that, so put them before it.
    """
    names, kinds = list(fields), list(fields.values())

    def batch(texts: pa.Array) -> pa.Array:
        rows = [per_text(x if x is not None else "") for x in texts.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.StructArray.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names)

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(batch, ddl).asNondeterministic()
    return lambda column: made(column.cast("string"))


def batch_udf(per_batch: Callable[[pa.Array], pa.StructArray], ddl: str) -> Callable[[Column], Column]:
    """The same for a function of a whole batch of texts (nulls left in)."""

    def batch(texts: pa.Array) -> pa.Array:
        return per_batch(texts)

    batch.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(batch, ddl).asNondeterministic()
    return lambda column: made(column.cast("string"))


def sampled_units(df: DataFrame, text: str, cut: Callable[[pa.Array], pa.Array], keep: int, sample_units: int = 262_144, longest: int = 48) -> list[str]:
    """The most frequent units of a sample of the column, at most keep of them, none over longest bytes.

    The sample is the first sample_units counts of distinct units in a batch, in the order in which Spark reads: a
    bound on what reaches the driver, whatever the input. The answer fills look-up tables, where a unit that is
    missing costs time and never changes a result; so no pass over the corpus and no shuffle is spent on it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = cut(batch.column(0)).value_counts()
            units, n = counted.field("values"), counted.field("counts")
            short = pc.less_equal(pc.binary_length(units), longest)
            yield pa.RecordBatch.from_arrays([units.filter(short), n.filter(short)], ["unit", "n"])

    short_batches(df.sparkSession)
    total: Counter = Counter()
    for r in df.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "unit string, n long").limit(sample_units).collect():
        total[r["unit"]] += r["n"]
    return sorted(total, key=lambda u: (-total[u], u))[:keep]


_state: dict = {}


def worker_state(value: object, build: Callable[[object], object]):
    """What a Python worker derives from a broadcast value: built once, and dropped when another value's turn comes.

    Workers outlive operators, so caches of one operator would otherwise stay beside the next one's.
    """
    if _state.get("of") is not value:
        _state.clear()
        gc.collect()
        _state.update(of=value, made=build(value))
    return _state["made"]


def short_batches(session, rows: int = 1024) -> None:
    """Arrow batches of at most `rows` rows in this session, unless its configuration names a number.

    Texts may be long; a worker holds a batch of them several times over.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not session.sparkContext.getConf().contains(name) and int(session.conf.get(name)) > rows:
        session.conf.set(name, str(rows))


class Memo(dict):
    """A dict that computes what it lacks. It holds at most `most` entries of the current generation and as many of the one before."""

    def __init__(self, compute: Callable, most: int = 200_000):
        super().__init__()
        self.compute, self.most, self.before = compute, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value
