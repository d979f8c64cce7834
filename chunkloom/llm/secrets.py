"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Every candidate (a span that one of the patterns finds) is hashed; hashes are counted by distinct repositories and
distinct owners over the whole corpus. A value that many owners hold is a copied example; a value that few owners hold
looks like a live credential.

Defined results: null text counts as empty (no spans); empty text has no spans; repeated rows each get their own row;
a null owner or repository counts as one owner or repository of its own; an empty table gives an empty result; very long
texts are searched whole; other columns pass through, whatever their names.

Texts are searched once: rows with their spans are written as a table, from which values are counted, judged and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._common import cut, free_names, table

#: The base patterns and least lengths of the contract. (kind, pattern, group that is the secret, least length)
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ with 24 or more characters
)
#: Token formats that issuers publish, added by the method.
VENDOR = ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 12)
KINDS = (*BASE, VENDOR)
#: A superset of the texts with spans: the same patterns with nothing captured.
_MAY = (r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", VENDOR[1])
#: A value that this many owners or more hold is a copied example.
EXAMPLE_OWNERS = 5
#: Positions are folded in blocks of this many matches, so that a text with very many matches costs no quadratic copying.
_BLOCK = 256
_SPAN = "struct<start:int,end:int,kind:int,value:string>"
_JUDGED = "array<struct<start:int,end:int,kind:int,value:string,n_owners:bigint,n_repos:bigint,live:boolean>>"


def may_hold(text: Column) -> Column:
    """True for every text that has a span (and for a few more); null text: false."""
    out = text.rlike(_MAY[0])
    for p in _MAY[1:]:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def _spans_of(text: Column, kind: int) -> Column:
    """Array of spans of one kind, in order: the pieces between matches and the matches alternate, so that running
    sums of their lengths are the positions, in code points."""
    _, pattern, group, least = KINDS[kind]
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["value"].alias("value")))

    def per_block(parts_col: Column) -> Column:
        n_blocks = F.ceil(F.size(parts_col) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(parts_col, b * _BLOCK + 1, F.lit(_BLOCK)))
        none = F.array().cast("array<struct<at:int,block:array<struct<gap:int,hit:int,value:string>>>>")
        placed = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, block: F.struct(
                F.aggregate(block, acc["at"], lambda s, x: s + x["gap"] + x["hit"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), block.alias("block")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return F.flatten(
            F.transform(
                placed,
                lambda p: F.aggregate(
                    p["block"],
                    F.struct(p["at"].alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")),
                    lambda acc, x: F.struct(
                        (acc["at"] + x["gap"] + x["hit"]).alias("at"),
                        F.concat(
                            acc["out"],
                            F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))),
                        ).alias("out"),
                    ),
                    lambda acc: acc["out"],
                ),
            )
        )

    spans = F.when(F.size(parts) > 0, per_block(parts)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return F.when(text.rlike(_MAY[kind]), F.filter(spans, lambda x: F.length(x["value"]) >= least)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _all_spans(text: Column) -> Column:
    """Spans of all kinds, by start, then kind."""
    found = F.array_sort(F.concat(*(_spans_of(text, k) for k in range(len(KINDS)))), lambda a, b: _order(a, b))
    return F.when(may_hold(text), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _order(a: Column, b: Column) -> Column:
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over the corpus, from rows of owner, repo and spans. Distinct by steps, each with a partial
    aggregation, so that a value that a third of all rows hold is summed before it is shuffled."""
    spans = found.select("owner", "repo", F.explode("spans").alias("s"))
    return (
        spans.select(F.sha2("s.value", 256).alias("hash"), "owner", "repo").distinct()
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    )


def judged(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """row and its spans with n_owners, n_repos and live (owner-specific), by start, then kind."""
    spans = found.select("row", F.explode("spans").alias("s")).withColumn("hash", F.sha2("s.value", 256))
    one = F.struct("s.start", "s.end", "s.kind", "s.value", "n_owners", "n_repos", (F.col("n_owners") < example_owners).alias("live"))
    return spans.join(ownership(found), "hash").groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("judged"))


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, out_col: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, unless given) with out_col: array of (start, end, kind, value, n_owners, n_repos,
    live), sorted by start, then kind."""
    keep = [c for c in (keep or docs.columns) if c != out_col]
    row, spans = free_names([*docs.columns, out_col], "s_row", "s_spans")
    wanted = list(dict.fromkeys((*keep, owner_col, repo_col)))
    searched = cut(docs.select(*wanted, F.monotonically_increasing_id().alias(row), _all_spans(F.col(text_col)).alias(spans)))
    some = searched.filter(F.size(spans) > 0)
    verdicts = judged(some.select(F.col(row).alias("row"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.col(spans).alias("spans")), example_owners).toDF(row, spans)
    none = F.array().cast(_JUDGED)
    held = some.drop(spans).join(verdicts, row).select(*keep, F.col(spans).cast(_JUDGED).alias(out_col))
    return held.unionByName(searched.filter(F.size(spans) == 0).select(*keep, none.alias(out_col)))


def _redacted(text: Column, live: Column, mark: str) -> Column:
    """text with the sorted spans of `live` replaced by mark, where they overlap the first of them. The text is taken apart
    in blocks of spans, so that no piece is looked up from the text's start and no long result is copied for each span."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(live) / _BLOCK).cast("int") - 1), lambda b: F.slice(live, b * _BLOCK + 1, F.lit(_BLOCK)))

    def within(part: Column, base: Column, at: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(part, acc["at"] - base + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            ),
        )

    def step(acc: Column, block: Column) -> Column:
        until = F.greatest(acc["at"], F.array_max(F.transform(block, lambda s: s["end"])))
        part = F.substring(acc["rest"], F.lit(1), until - acc["at"])
        return F.struct(
            until.alias("at"),
            F.substring(acc["rest"], until - acc["at"] + 1, F.length(acc["rest"])).alias("rest"),
            F.concat(acc["out"], F.array(within(part, acc["at"], acc["at"], block)["out"])).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(blocks, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "[SECRET]", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs with the value of every owner-specific secret replaced by mark; copied examples and all other text stay."""
    (found,) = free_names(docs.columns, "s_found")
    live = F.array_sort(F.transform(F.filter(found, lambda s: s["live"]), lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"))))
    out = scan(docs, text_col, owner_col, repo_col, example_owners, found)
    return out.withColumn(text_col, F.when(F.exists(found, lambda s: s["live"]), _redacted(F.col(text_col), live, mark)).otherwise(F.col(text_col))).select(*docs.columns)


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents; a document is its own repository and its source the owner. The base spans
    stay whatever their frequency; of the added kind, those that look live do."""
    found = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    kept = F.filter("secrets", lambda s: (s["kind"] < len(BASE)) | s["live"])
    return found.select(
        "doc_id",
        *(F.size(F.expr(f"filter(secrets, s -> s.kind = {k})")).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(len(BASE))),
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(kept).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("secrets", lambda s: ~s["live"])).cast("long").alias("n_examples"),
    )
