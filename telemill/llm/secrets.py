"""Secret scan with corpus-wide ownership.

Every whole text is scanned for three kinds of spans: assignments of a secret, cloud access keys and
long hexadecimal runs. Their values are hashed and counted over the corpus: in how many distinct
repositories, and with how many distinct owners, a value occurs. A value of at least ``shared_owners``
owners or at least ``shared_repositories`` repositories is marked ``example`` (a widely copied sample).
Any other value of one owner is marked ``live`` (it looks like that owner's credential). A value of
several owners below both limits (two owners, by default) is undecided and has no mark. The marks are
further spans, over the value; the scanned spans all stay.

Distinct repositories and owners are counted by grouping twice, so that a value copied into a third
of all rows is combined in each task before anything is sent.

Nulls and ties: null text counts as empty; a row without spans has zero counts and empty ``spans``. A
null owner or repository counts as one owner or repository of its own. Repeated rows give repeated
results. Equal starts are ordered by kind. Other columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.staging import staged

KINDS = ("assign", "access", "hex", "live", "example")
_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_SPAN = "struct<start: bigint, kind: int, end: bigint>"
_FOUND = (
    "row bigint, doc_id {kind}, repository string, owner string, "
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    f"base array<{_SPAN}>, "
    "candidates array<struct<start: bigint, end: bigint, hash: string>>"
)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans ``(start, kind, end)`` in order, and the value's ``(start, end)`` of each."""
    found = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                found.append((m.start(), 1, m.end(), m.start(), m.end()))
    for m in _HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m.start(), m.end()))
    found.sort()
    return [f[:3] for f in found], [f[3:] for f in found]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        rows = []
        for k in range(len(texts)):
            text = texts[k].as_py() or ""
            spans, values = spans_of(text)
            kinds = [s[1] for s in spans]
            unique = {v: hashlib.md5(text[v[0] : v[1]].encode("utf-8", "replace")).hexdigest() for v in values}
            rows.append((
                kinds.count(0),
                kinds.count(1),
                kinds.count(2),
                hashlib.sha256(_joined(spans).encode()).hexdigest(),
                [{"start": s, "kind": kind, "end": e} for s, kind, e in spans],
                [{"start": s, "end": e, "hash": h} for (s, e), h in sorted(unique.items())],
            ))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        fixed = [batch.column(name) for name in ("row", "doc_id", "repository", "owner")]
        yield pa.RecordBatch.from_arrays(
            fixed + [pa.array(list(c), schema.field(4 + i).type) for i, c in enumerate(columns)], schema=schema
        )


def scan(documents: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """All base spans and candidate values, stored: one row per document, numbered by ``row``."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        "text",
    )
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    value = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([
                ("row", pa.int64()),
                ("doc_id", batch.column("doc_id").type),
                ("repository", pa.string()),
                ("owner", pa.string()),
                ("n_assign", pa.int64()),
                ("n_access", pa.int64()),
                ("n_hex", pa.int64()),
                ("base_sha256", pa.string()),
                ("base", pa.list_(span)),
                ("candidates", pa.list_(value)),
            ])
            yield from _scan([batch], schema)

    return staged(rows.mapInArrow(run, _FOUND.format(kind=kind)), "secret-scan")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repositories, n_owners`` of every candidate value in the corpus."""
    uses = found.select(F.explode("candidates.hash").alias("hash"), "repository", "owner")
    return (
        uses.groupBy("hash", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash")
        .agg(F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    )


def secrets(
    documents: DataFrame,
    repository: str = "doc_id",
    owner: str = "source",
    shared_owners: int = 3,
    shared_repositories: int = 10,
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, and ``n_live, n_example``.

    A repository is taken to belong to its owner; the same name under two owners counts twice.
    """
    found = scan(documents, repository, owner)
    copied = (F.col("n_owners") >= shared_owners) | (F.col("n_repositories") >= shared_repositories)
    marks = (
        found.select("row", F.explode("candidates").alias("c"))
        .join(ownership(found), F.col("c.hash") == F.col("hash"))
        .select(
            "row",
            F.col("c.start").alias("start"),
            F.when(copied, F.lit(4)).when(F.col("n_owners") == 1, F.lit(3)).alias("kind"),
            F.col("c.end").alias("end"),
        )
        .where("kind IS NOT NULL")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("marks"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    none = F.array().cast(f"array<{_SPAN}>")
    everything = F.array_sort(F.concat("base", F.coalesce("marks", none)))
    marked = found.join(marks, "row", "left")
    count = lambda kind: F.size(F.filter(F.coalesce("marks", none), lambda m: m["kind"] == kind)).cast("bigint")
    return marked.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_join(
            F.transform(everything, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
        ).alias("spans"),
        count(3).alias("n_live"),
        count(4).alias("n_example"),
    )
