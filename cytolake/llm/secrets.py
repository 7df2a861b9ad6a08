"""Secret scans: pattern spans, told apart by how widely the corpus shares their values.

Every candidate value is hashed; its distinct repositories and owners are counted over the whole corpus. Values that
many owners carry are copied examples; the others look live. Spans of the looser shapes below count only when live.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_slices, materialize, read_table, tidy

#: The base kinds in listed order, and the kind that the method adds.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Longer runs of credential characters; a value must mix upper case, lower case and digits.
TOKEN = re.compile(r"[A-Za-z0-9_-]{24,}")
MIXED = [re.compile(x) for x in ("[A-Z]", "[a-z]", "[0-9]")]
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this finds the runs of HEX that pass

MAX_SLICE = 4 << 20


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: s[:2])


def extra_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the added kind: mixed runs that no base span overlaps. base is in order of start."""
    out, i, reach = [], 0, 0  # reach: the furthest end of the base spans that start before the run's end
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start() and all(p.search(m[0]) for p in MIXED):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def scan(docs: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """One row per row of docs with its base digest and all candidate spans; written once, so that its row ids hold."""
    out = "doc_id long, repo string, owner string, base_sha256 string, found array<struct<start:int,kind:int,end:int,h:long>>"

    def run(batches):
        item = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("h", pa.int64())])
        for b in batches:
            for part in bounded_slices(b, "text", MAX_SLICE):
                shas, spans = [], []
                for x in part.column("text"):
                    text = x.as_py() or ""
                    base = base_spans(text)
                    shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                    spans.append([{"start": s, "kind": k, "end": e, "h": _hash(v)} for s, k, e, v in base + extra_spans(text, base)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("repo"), part.column("owner"), pa.array(shas, pa.string()), pa.array(spans, pa.list_(item))], ["doc_id", "repo", "owner", "base_sha256", "found"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), "text")
    return materialize(text.mapInArrow(tidy(run), out).withColumn("rid", F.monotonically_increasing_id()), "secrets-scan")


def judged(scanned: DataFrame, min_owners: int, min_repos: int) -> DataFrame:
    """Spans by row id: start, kind, end, live. A value is an example if at least min_owners owners and min_repos
    repositories have it. Null owners and repositories are no owner and no repository.

    Only the examples are joined back to the spans: few values, written as a table so that the planner knows its size."""
    flat = scanned.select("rid", "repo", "owner", F.explode("found").alias("s")).select("rid", "repo", "owner", "s.*")
    counts = flat.groupBy("h").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    examples = materialize(counts.where((F.col("owners") >= min_owners) & (F.col("repos") >= min_repos)).select("h", F.lit(True).alias("example")), "secrets-examples")
    spans = flat.select("rid", "start", "kind", "end", "h").join(examples, "h", "left").withColumn("live", F.col("example").isNull())
    return spans.where((F.col("kind") < 3) | F.col("live")).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))


def find_secrets(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", min_owners: int = 3, min_repos: int = 3) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token (spans that the method adds), n_example and
    n_live: how many of the spans have values that are widely shared, and how many have others.

    Null and empty texts have no spans. Repeated rows are found each, and are one repository by their id. Spans of a kind
    do not overlap; those that start together are in the order of KINDS. Long texts are read in time proportional to
    their length. Columns besides the ones named are not read, whatever their names. An empty table gives no rows."""
    scanned = scan(docs, repo_col, owner_col)
    spans = judged(scanned, min_owners, min_repos)
    both = scanned.join(spans, "rid", "left")
    n = lambda k: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == k)), F.lit(0)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n_live = F.coalesce(F.size(F.filter("spans", lambda s: s["live"])), F.lit(0)).cast("long")
    fixed = lambda c: F.when(F.col("spans").isNull(), 0).otherwise(c).cast("long")
    return both.select(
        "doc_id", fixed(n(0)).alias("n_assign"), fixed(n(1)).alias("n_access"), fixed(n(2)).alias("n_hex"), "base_sha256",
        F.coalesce(joined, F.lit("")).alias("spans"), fixed(n(3)).alias("n_token"), fixed(F.size("spans") - n_live).alias("n_example"), fixed(n_live).alias("n_live"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", min_owners: int = 3, min_repos: int = 3) -> DataFrame:
    """docs with every live-looking secret masked in text, and n_chars following; all rows stay, in the columns of docs,
    which may have any names besides doc_id, text and source.

    Verdicts come back to a text by its doc_id and text hash; rows equal in both are masked alike. Null and empty texts
    stay as they are, and an empty table stays empty. The cuts are written as a table first, so that the planner knows
    whether they are small enough to be sent to the texts, or both have to be shuffled."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no name of the table meets one of this function
    at = docs.columns.index("text")
    key = F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("?")), F.xxhash64(docs["text"]).cast("string"))
    scanned = scan(docs.select("doc_id", "text", key.alias("repo"), F.col("source").alias("owner")), "repo", "owner")
    live = scanned.join(judged(scanned, min_owners, min_repos), "rid").select("repo", F.filter("spans", lambda s: s["live"]).alias("cuts")).where(F.size("cuts") > 0)
    cuts = materialize(live.groupBy("repo").agg(F.first("cuts").alias("cuts")), "secrets-cuts")
    own_key = F.concat_ws(":", F.coalesce(own[f"c{docs.columns.index('doc_id')}"].cast("string"), F.lit("?")), F.xxhash64(own[f"c{at}"]).cast("string"))
    rows = own.withColumn("repo", own_key).join(cuts, "repo", "left").select(*own.columns, "cuts")

    def run(batches):
        for b in batches:
            for part in bounded_slices(b, f"c{at}", MAX_SLICE):
                texts = part.column(at).to_pylist()
                for i, cuts in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    if cuts:
                        texts[i] = _masked(texts[i], cuts, mask)
                cols = [pa.array(texts, part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns[:-1])]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(list(part.schema)[:-1]))

    masked = rows.mapInArrow(tidy(run), own.schema).toDF(*docs.columns)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def _masked(text: str, cuts: list[dict], mask: str) -> str:
    """Cuts may overlap; what they cover together becomes one mask."""
    out, at = [], 0
    for c in sorted(cuts, key=lambda c: c["start"]):
        if c["start"] >= at:
            out += [text[at : c["start"]], mask]
        at = max(at, c["end"])
    return "".join(out) + text[at:]


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


def _sql_spans(kind: int, pattern: str, group: int, wanted: str) -> str:
    """Spans of a kind: what lies between matches gives their places."""
    return f"""SELECT doc_id, repo, owner, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
      s := list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), n := length(m[i]), v := v[i]))) AS x
    FROM (SELECT doc_id, doc_id::VARCHAR AS repo, source AS owner, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p FROM texts) WHERE {wanted}"""


_SQL_ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_SQL_NAMES = "['" + "', '".join(KINDS) + "'][kind + 1] || ':' || s || ':' || e"
OP4_SQL = f"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_id, repo, owner, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e, x.v AS v FROM (
    {_sql_spans(0, _SQL_ASSIGN, 2, "len(m) > 0")}
    UNION ALL {_sql_spans(1, "AKIA[A-Z0-9]+", 0, "len(m) > 0")}
    UNION ALL {_sql_spans(2, "[0-9a-f]{32,}", 0, "len(m) > 0")})
  WHERE length(x.v) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
runs AS (SELECT doc_id, repo, owner, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e, x.v AS v FROM ({_sql_spans(3, "[A-Za-z0-9_-]{24,}", 0, "len(m) > 0")})
  WHERE regexp_matches(x.v, '[A-Z]') AND regexp_matches(x.v, '[a-z]') AND regexp_matches(x.v, '[0-9]')),
found AS (SELECT * FROM base UNION ALL SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND r.s < b.e)),
examples AS (SELECT v FROM found GROUP BY v HAVING count(DISTINCT owner) >= 3 AND count(DISTINCT repo) >= 3),
judged AS (SELECT *, v NOT IN (SELECT v FROM examples) AS live FROM found),
kept AS (SELECT * FROM judged WHERE kind < 3 OR live),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_token,
    count(*) FILTER (NOT live) AS n_example, count(*) FILTER (live) AS n_live,
    coalesce(string_agg({_SQL_NAMES}, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base_, string_agg({_SQL_NAMES}, ',' ORDER BY s, kind) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_token, 0) AS n_token, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
FROM texts LEFT JOIN told USING (doc_id)
"""
