"""Vector codes by product quantization; nearest entries by float32 screening with rounding-error intervals.

A product in float32 tells most nearest entries apart, but not ties or close
ones. An inner product of d terms, both factors rounded to float32 and summed in
any order, is off by at most g |x| |c| with g = n u / (1 - n u), n = d + 2,
u = 2**-24. That gives every entry an interval for |c|^2 - 2 x.c; an entry whose
interval lies above the smallest upper end can't be nearest. Where more than one
is left, exactly these are evaluated again in int64, and ties go to the lowest
index.

Each round is one pass in which a task adds up what its rows give to an entry;
Spark adds up tasks. Codebooks alone (entries times components) meet at the
driver, whose size doesn't depend on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A vector's length times its largest component's square is below this, so that squared distances fit int64.
LARGEST = 1 << 61
#: Rows that are screened at a time.
BLOCK = 1 << 14


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the index of its nearest entry, the squared distance, and how many rows were evaluated again.

    x and book hold int64 within LARGEST; ties go to the lowest index.
    """
    terms = x.shape[1] + 2
    u32, u64 = 2.0**-24, 2.0**-53
    g = terms * u32 / (1 - terms * u32)
    product = (x.astype(np.float32) @ book.T.astype(np.float32)).astype(np.float64)
    squares = (book * book).sum(axis=1)
    near = squares.astype(np.float64)[None, :] - 2 * product
    # Norms are rounded too, so they count a little more; the last term is the rounding of the difference itself.
    sizes = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares.astype(np.float64))[None, :]
    radius = 2 * g * sizes * (1 + 1e-9) + 8 * u64 * (squares.astype(np.float64)[None, :] + 2 * np.abs(product)) + 1e-9
    left = near - radius <= (near + radius).min(axis=1)[:, None]
    best = left.argmax(axis=1)
    open_rows = np.flatnonzero(left.sum(axis=1) > 1)
    if open_rows.size:
        rows, entries = np.nonzero(left[open_rows])
        exact = np.full((len(open_rows), len(book)), np.iinfo(np.int64).max)
        exact[rows, entries] = ((x[open_rows[rows]] - book[entries]) ** 2).sum(axis=1)
        best[open_rows] = exact.argmin(axis=1)  # the first of equals
    return best, ((x - book[best]) ** 2).sum(axis=1), len(open_rows)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, BLOCK):
        yield batch.slice(a, BLOCK)


def scaled(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): floor(scale x) of each component x as a double, of rows whose vector can take part."""
    largest = F.sqrt(F.lit(float(LARGEST)) / F.greatest(F.size("v"), F.lit(1))) - 1
    ok = F.forall("v", lambda x: F.coalesce(F.abs(F.lit(float(scale)) * x.cast("double")) < largest, F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    return rows.where(F.col("v").isNotNull() & ok).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int")))


def first_books(rows: DataFrame, size: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors (of `size` components) of the smallest ids, ascending; the last ones are filled up with zeros."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    wide = -(-size // parts)
    held = np.array([r.v for r in first], np.int64).reshape(len(first), size)
    held = np.pad(held, ((0, 0), (0, wide * parts - size)))
    return [held[:, p * wide : (p + 1) * wide] for p in range(parts)]


def _parts(x: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    wide = books[0].shape[1]
    x = np.pad(x, ((0, 0), (0, wide * len(books) - x.shape[1])))
    for p in range(len(books)):
        yield p, np.ascontiguousarray(x[:, p * wide : (p + 1) * wide])


def improved(rows: DataFrame, size: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry as the floor of the mean of the parts nearest to it; entries with none stay."""
    shape = (len(books), *books[0].shape)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            for block in _blocks(batch):
                for p, x in _parts(_matrix(block.column("v"), size), books):
                    best, _, _ = nearest(x, books[p])
                    np.add.at(sums[p], best, x)
                    counts[p] += np.bincount(best, minlength=shape[1])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"]
        )

    told = rows.select("v").mapInArrow(add_up, "part int, entry int, n long, s array<bigint>")
    cells = told.select("part", "entry", "n", F.posexplode("s").alias("k", "x")).groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    for r in cells.collect():  # parts x entries x components at most
        out[r.part][r.entry, r.k] = r.x // r.n
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of each row whose vector takes part.

    Vectors count as floor(4096 x) and are cut into `parts` equal runs, each
    with a codebook that begins as the parts of the `entries` smallest ids and
    is improved for some rounds. code: the nearest entry of each part, two hex
    digits each; error: the squared distances, summed; label_error: the error
    summed over rows of the same label (nulls together); codebooks_sha256: of
    all final entries' components.

    No part take vectors that are null or hold a component that is null, not
    finite or so large that squared distances might not fit int64 (some 46,000
    for 64 components), and those of another length than the one of the
    smallest id. A length that doesn't divide is filled up with
    zeros, which change no distance. Of fewer rows than entries each is one.
    Rows of one id keep their order by their vectors, null ids come last; all
    rows are kept. An empty table gives no rows. Other columns play no part.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits, so at most 256 entries")
    rows = written(scaled(vectors, SCALE, id_col, vector_col, label_col))
    least = rows.select("id", "v", F.size("v").alias("size")).orderBy(F.asc_nulls_last("id"), "v").first()
    size = least["size"] if least else 0
    rows = rows.where(F.size("v") == size)
    books = first_books(rows, size, parts, entries)
    for _ in range(rounds if size else 0):
        books = improved(rows, size, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{k:02x}" for k in range(256)], object)
        for batch in batches:
            for block in _blocks(batch):
                error, codes = np.zeros(block.num_rows, np.int64), []
                for p, x in _parts(_matrix(block.column("v"), size), books):
                    best, off, _ = nearest(x, books[p])
                    codes.append(digits[best])
                    error += off
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("label"), pa.array(sum(codes[1:], codes[0]), pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    kind = vectors.schema[label_col].dataType.simpleString()
    coded = written(rows.mapInArrow(encode, f"id long, label {kind}, code string, error long"))
    # A label's sum is one row, so the join may deal a hot label's rows to several tasks.
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same as DuckDB SQL: the rounds one after the other, all distances in whole numbers."""
    steps = []
    distance = "list_sum(list_transform(list_zip(s.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for n in range(rounds + 1):
        steps.append(f"""
near{n} as materialized (
  select vec_id, part, arg_min(entry, (d, entry)) as entry, cast(min(d) as bigint) as d
  from (select s.vec_id, s.part, b.entry, {distance} as d from sliced s join book{n} b using (part))
  group by vec_id, part
)""")
        if n < rounds:
            steps.append(f"""
mean{n} as materialized (
  select part, entry, list(m order by k) as x from (
    select part, entry, k, cast((sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*) as bigint) as m
    from (select near{n}.part, near{n}.entry, unnest(range({{wide}})) as k, unnest(s.x) as v from near{n} join sliced s using (vec_id, part))
    group by part, entry, k) group by part, entry
), book{n + 1} as materialized (
  select b.part, b.entry, coalesce(m.x, b.x) as x from book{n} b left join mean{n} m using (part, entry)
)""")
    body = ",".join(steps).replace("{wide}", "len(s.x)")
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), sliced as materialized (
  select vec_id, p as part, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) as x
  from (select vec_id, v, unnest(range({parts})) as p from kept)
), firsts as (
  select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {entries}
), book0 as materialized (
  select part, entry, x from sliced join firsts using (vec_id)
),{body},
coded as (
  select vec_id, string_agg(printf('%02x', cast(entry as integer)), '' order by part) as code, cast(sum(d) as bigint) as error from near{rounds} group by vec_id
), digest as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds}
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (vec_id) cross join digest
"""
