"""From parsed questions to query specifications, with a warning for everything set aside."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions import text as X

PARSED = "query_id string, question string, is_global boolean, facets array<struct<domain:string,notion:string,description:string,span:string>>, source struct<concept:string,state:string,span:string>, target struct<concept:string,state:string,span:string>, place string"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda many: [None if x is None else unicodedata.normalize("NFC", x) for x in many])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda many: [None if x is None else unicodedata.normalize("NFKC", x) for x in many])


def _stated(question: Column, span: Column) -> Column:
    return F.coalesce(F.contains(question, span), F.lit(False))


def specify(parsed: DataFrame) -> DataFrame:
    """(query_id, mode, facets, source, target, warnings) of parsed questions (see PARSED).

    What the question does not say word for word is discarded; so are endpoints without a
    direction to look for (unspecified, spatial, comparative, compound), and a canonical
    direction that its words do not contain. Warnings come in the order of the checks.
    """
    x = parsed.withColumn("facets", F.coalesce("facets", F.array().cast("array<struct<domain:string,notion:string,description:string,span:string>>")))
    x = x.withColumn("_n", _nfc(F.array("question", "source.span", "target.span", "place"))).withColumn("_f", _nfc(F.transform("facets", lambda f: f["span"])))
    x = x.withColumn("_k", _nfkc("_f"))
    q, place = F.col("_n")[0], F.col("_n")[3]
    keyed = F.zip_with("_f", "_k", lambda s, k: F.struct(s.alias("span"), X.key_of(F.lower(F.coalesce(k, F.lit("")))).alias("key")))
    whole = F.zip_with("facets", keyed, lambda f, s: F.struct(f["domain"].alias("domain"), f["notion"].alias("notion"), f["description"].alias("description"), s["span"].alias("span"), s["key"].alias("key")))
    x = x.withColumn("_all", whole).withColumn("_place", X.text_key(place)).withColumn("_kept", F.filter("_all", lambda f: _stated(q, f["span"])))
    same_place = lambda f: (f["domain"] == "spatial_configuration") & (f["key"] == F.col("_place"))
    x = x.withColumn("_facets", F.when(place.isNull(), F.col("_kept")).otherwise(F.filter("_kept", lambda f: ~F.coalesce(same_place(f), F.lit(False)))))
    for side, i in (("source", 1), ("target", 2)):
        there = F.col(side).isNotNull()
        x = x.withColumn(f"_{side}_bad", there & ~_stated(q, F.col("_n")[i]))
        x = x.withColumn(f"_{side}", F.when(there & ~F.col(f"_{side}_bad"), F.col(side)))
    x = x.withColumn("_global", X.asks_globally(q))
    problem = F.when(F.col("_target").isNotNull(), X.endpoint_problem(F.col("_target.concept"), F.col("_target.state"), q, True))
    compared = F.when(F.col("_source").isNotNull(), X.endpoint_problem(F.col("_source.concept"), F.col("_source.state"), q, False)) == "comparative"
    x = x.withColumn("_problem", problem)
    x = x.withColumn("_compared", F.coalesce(compared, F.lit(False)) | F.coalesce(F.col("_problem") == "comparative", F.lit(False)))
    x = x.withColumn("_source", F.when(~F.col("_compared"), F.col("_source"))).withColumn("_target", F.when(~F.col("_compared") & F.col("_problem").isNull(), F.col("_target")))
    for side in ("source", "target"):
        state = X.text_key(F.col(f"_{side}.state"))
        unsaid = (state != "") & ~F.contains(X.text_key(F.col(f"_{side}.span")), state) & (X.canonical_direction(state) == state)
        x = x.withColumn(f"_{side}_unsaid", F.coalesce(F.col(f"_{side}").isNotNull() & unsaid, F.lit(False)))
        blank = F.struct(F.col(f"_{side}.concept").alias("concept"), F.lit("").alias("state"), F.col(f"_{side}.span").alias("span"))
        x = x.withColumn(f"_{side}", F.when(F.col(f"_{side}_unsaid"), blank).otherwise(F.col(f"_{side}")))
    bad_span = (F.size("_kept") < F.size("_all")) | F.col("_source_bad") | F.col("_target_bad")
    warn = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    warnings = F.array_compact(
        F.array(
            warn(~F.col("_global").eqNullSafe(F.coalesce("is_global", F.lit(False))), "GLOBAL_FLAG_NORMALIZED"), warn(bad_span, "SUPPORTING_SPAN_DISCARDED"),
            warn(F.size("_facets") < F.size("_kept"), "DUPLICATE_PLACE_DISCARDED"), warn(F.col("_problem") == "unspecified_state", "UNSPECIFIED_TARGET_DISCARDED"),
            warn(F.col("_problem") == "spatial_relation", "SPATIAL_TARGET_DISCARDED"), warn(F.col("_compared"), "COMPARATIVE_ENDPOINTS_DISCARDED"),
            warn(F.col("_problem") == "compound", "COMPOUND_TARGET_DISCARDED"), warn(F.col("_source_unsaid"), "SOURCE_STATE_CLEARED"), warn(F.col("_target_unsaid"), "TARGET_STATE_CLEARED"),
        )
    )
    facets = F.transform("_facets", lambda f, i: F.struct(F.format_string("%s_F%03d", F.col("query_id"), i + 1).alias("id"), f["domain"].alias("domain"), f["notion"].alias("notion"), f["description"].alias("description")))
    return x.select("query_id", X.query_mode(F.col("_global"), F.col("_source"), F.col("_target")).alias("mode"), facets.alias("facets"), F.col("_source").alias("source"), F.col("_target").alias("target"), warnings.alias("warnings"))


def suffix_matches(wanted: DataFrame, allowed: DataFrame) -> DataFrame:
    """(group, ref, id): references that are no id but end exactly one allowed id after a colon.

    ``wanted``: group, ref; ``allowed``: group, id. The ids' suffixes are listed, so the join
    is on equal values.
    """
    parts = F.split("id", ":")
    ends = allowed.select("group", "id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ":"))).alias("ref"))
    open_refs = wanted.join(allowed.select("group", F.col("id").alias("ref")), ["group", "ref"], "left_anti").distinct()
    hit = open_refs.join(ends.where("ref <> ''").distinct(), ["group", "ref"])
    return hit.groupBy("group", "ref").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").select("group", "ref", "id")


def page_checks(elements: DataFrame, expected: DataFrame) -> DataFrame:
    """(paper_id, problem) of parsed papers: pages that lack, too little text, broken characters.

    ``elements``: paper_id, page, text; ``expected``: paper_id, n_pages.
    """
    g = elements.groupBy("paper_id").agg(F.count_distinct("page").alias("pages"), F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars"), F.max(F.coalesce(F.contains(F.col("text"), F.lit("�")), F.lit(False))).alias("broken"))
    x = expected.join(g, "paper_id", "left")
    found = F.array_compact(F.array(F.when(F.coalesce("pages", F.lit(0)) != F.col("n_pages"), "PAGES_MISSING"), F.when(F.coalesce("chars", F.lit(0)) < 100, "PARSE_EMPTY"), F.when(F.coalesce("broken", F.lit(False)), "PARSE_ENCODING_ERROR")))
    return x.select("paper_id", F.explode(found).alias("problem"))


def suite_summary(checks: DataFrame, cases: DataFrame) -> DataFrame:
    """(cases, passed, failed, blocked): cases of a suite by their checks (query_id, check, passed); without any they are blocked."""
    per = checks.groupBy("query_id").agg(F.min(F.col("passed").cast("int")).alias("ok"))
    x = cases.select("query_id").join(per, "query_id", "left")
    return x.agg(F.count("*").alias("cases"), F.count_if(F.col("ok") == 1).alias("passed"), F.count_if(F.col("ok") == 0).alias("failed"), F.count_if(F.col("ok").isNull()).alias("blocked"))


def map_tree(contexts: DataFrame) -> DataFrame:
    """(paper_id, pos, line): a paper's contexts as an indented tree; a context met again is marked and not opened.

    ``contexts``: paper_id, pos, id, parent_ids, label, aliases. Depth first in input order,
    one paper's labels a task.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        label = {r.id: f"{r.label} [{r.id}]" + (f"; aliases: {', '.join(r.aliases)}" if r.aliases is not None and len(r.aliases) else "") for r in g.itertuples()}
        below: dict[str, list[str]] = {}
        tops = []
        for r in g.itertuples():
            ups = [p for p in (r.parent_ids if r.parent_ids is not None else ()) if p in label]
            for p in ups:
                below.setdefault(p, []).append(r.id)
            if not ups:
                tops.append(r.id)
        lines, seen = [], set()
        # what hangs only from a loop has no top: it is opened last, where it was not met before
        for start in [*tops, *label]:
            if start in seen:
                continue
            todo = [(start, 0)]
            while todo:
                c, depth = todo.pop()
                lines.append("  " * depth + f"- {label[c]}" + ("; also inherits elsewhere" if c in seen else ""))
                if c not in seen:
                    seen.add(c)
                    todo += [(k, depth + 1) for k in reversed(below.get(c, ()))]
        return pd.DataFrame({"paper_id": g.paper_id.iloc[0], "pos": range(len(lines)), "line": lines})

    return contexts.groupBy("paper_id").applyInPandas(run, "paper_id string, pos int, line string")
