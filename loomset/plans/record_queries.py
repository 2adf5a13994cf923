"""Queries over derived records, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.config import ANIMA, ExportProfile
from loomset.functions import paths
from loomset.functions.text import spaced
from loomset.operators import captions, edits, filters, groups, postings, stats, tags, token_budget, versions
from loomset.plans.derive import CAPTIONS_SQL, MANUAL, SQL, conversations, exported, records, table
from loomset.storage import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"


def _joined(c: str, sep: str = "|") -> F.Column:
    return F.array_join(c, sep)


# --- tags ---


@query("suppressed_set", _with(SQL) + "SELECT u.user_id, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS suppressed FROM u LEFT JOIN supp USING (user_id) GROUP BY u.user_id")
def suppressed_set(spark, d: str) -> DataFrame:
    return records(spark, d).select("user_id", _joined(F.array_sort(tags.suppressed(F.col("manual_tags")))).alias("suppressed"))


@query("positive_manual", _with(SQL) + "SELECT u.user_id, coalesce(string_agg(tag, '|' ORDER BY ord), '') AS positive, count(tag) FILTER (trim(tag) LIKE '\\_%' ESCAPE '\\')::BIGINT AS organizational FROM u LEFT JOIN pos USING (user_id) GROUP BY u.user_id")
def positive_manual(spark, d: str) -> DataFrame:
    p = tags.positives(F.col("manual_tags"))
    return records(spark, d).select("user_id", F.array_join(p, "|").alias("positive"), F.size(F.filter(p, tags.is_organizational)).cast("long").alias("organizational"))


@query("is_suppressed", _with(SQL) + "SELECT user_id, tag, (user_id, lower(tag)) IN (SELECT user_id, tag FROM supp) AS suppressed FROM a")
def is_suppressed(spark, d: str) -> DataFrame:
    r = records(spark, d).select("user_id", "manual_tags", F.explode("auto_tags").alias("x"))
    return r.select("user_id", F.col("x.tag").alias("tag"), tags.is_suppressed(F.col("x.tag"), F.col("manual_tags")).alias("suppressed"))


@query("effective_tags", _with(SQL) + "SELECT u.user_id, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS tags FROM u LEFT JOIN eff USING (user_id) GROUP BY u.user_id")
def effective_tags(spark, d: str) -> DataFrame:
    return records(spark, d).select("user_id", F.array_join(tags.effective(F.col("manual_tags"), F.col("auto_tags"), F.col("booru_tags")), "|").alias("tags"))


def _export_sql(select: str = "string_agg(shown, '|' ORDER BY src, ord)", **options) -> str:
    return _with(SQL, exported(**options)) + f"SELECT u.user_id, coalesce({select}, '') AS tags FROM u LEFT JOIN first USING (user_id) GROUP BY u.user_id"


def _tags(spark, d: str, profile: ExportProfile) -> DataFrame:
    return tags.build_tags(records(spark, d), profile).select("user_id", _joined("tags").alias("tags"))


@query("export_text", _export_sql("string_agg(replace(shown, '_', ' '), ', ' ORDER BY src, ord)"))
def export_text(spark, d: str) -> DataFrame:
    return tags.export_text(records(spark, d), ANIMA).select("user_id", F.col("text").alias("tags"))


@query("build_tags", _export_sql())
def build_tags(spark, d: str) -> DataFrame:
    return _tags(spark, d, ANIMA)


@query("build_tags_plain", _export_sql(prefix=""))
def build_tags_plain(spark, d: str) -> DataFrame:
    return _tags(spark, d, ExportProfile())


@query("build_tags_threshold", _export_sql(threshold=0.9))
def build_tags_threshold(spark, d: str) -> DataFrame:
    return _tags(spark, d, ExportProfile(threshold=0.9, category_prefixes={"artist": "@"}))


@query("build_tags_exclude", _export_sql(exclude="meta"))
def build_tags_exclude(spark, d: str) -> DataFrame:
    return _tags(spark, d, ExportProfile(exclude_categories=("meta",), category_prefixes={"artist": "@"}))


@query("build_tags_long", _with(SQL, exported()) + "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY src, ord))::BIGINT AS place, shown AS tag FROM first")
def build_tags_long(spark, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    long = tags.exported_long(records(spark, d), ANIMA, "user_id")
    return long.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ord")).cast("long").alias("place"), "tag")


@query("export_shuffled_set", _with(SQL, exported()) + "SELECT u.user_id, count(shown)::BIGINT AS n, coalesce(string_agg(shown, '|' ORDER BY shown), '') AS tags FROM u LEFT JOIN first USING (user_id) GROUP BY u.user_id")
def export_shuffled_set(spark, d: str) -> DataFrame:
    """Shuffled export holds the same tags in another order."""
    p = ExportProfile(shuffle=True, category_prefixes={"artist": "@"})
    return tags.build_tags(records(spark, d), p, seed=7).select("user_id", F.size("tags").cast("long").alias("n"), F.array_join(F.array_sort("tags"), "|").alias("tags"))


@query("auto_tag_rank", _with(SQL) + "SELECT user_id, string_agg(tag, '>' ORDER BY ord) AS ranked, max(tag) FILTER (ord = 1) AS top FROM auto GROUP BY user_id")
def auto_tag_rank(spark, d: str) -> DataFrame:
    scored = F.transform("auto_tags", lambda x, i: F.struct(x.tag.alias("tag"), x.score.alias("score"), i.alias("idx")))
    r = records(spark, d).select("user_id", stats.ranked_tags(F.array_sort(scored)).alias("r"))
    return r.select("user_id", F.array_join(F.transform("r", lambda x: x.tag), ">").alias("ranked"), F.col("r")[0]["tag"].alias("top"))


@query("tag_scores_first_max", _with(SQL) + "SELECT user_id, (list_position(s, list_max(s)) - 1)::BIGINT AS place FROM (SELECT user_id, list(score ORDER BY tag) AS s FROM auto GROUP BY user_id)")
def tag_scores_first_max(spark, d: str) -> DataFrame:
    by_tag = F.transform(F.array_sort(F.transform("auto_tags", lambda x: F.struct(x.tag.alias("tag"), x.score.alias("score")))), lambda x: x.score)
    return records(spark, d).select("user_id", stats.first_max(by_tag).alias("place"))


# --- groups ---

GROUP = ["_reviewed", "error"]
_CLASSES = """, present AS (
  SELECT u.user_id, coalesce(list(g.tag ORDER BY g.ord) FILTER (g.tag IS NOT NULL), []) AS p FROM u LEFT JOIN (SELECT e.user_id, g.* FROM eff e JOIN (VALUES (1, '_reviewed'), (2, 'error')) AS g(ord, tag) ON lower(trim(g.tag)) = e.tag) g USING (user_id) GROUP BY u.user_id
), classes AS (
  SELECT user_id, CASE len(p) WHEN 0 THEN 'unset' WHEN 1 THEN 'tag' ELSE 'violation' END AS state, CASE WHEN len(p) = 1 THEN p[1] END AS tag, CASE WHEN len(p) > 1 THEN array_to_string(p, '|') END AS tags FROM present
)"""


def _classified(spark, d: str) -> DataFrame:
    return groups.classify(records(spark, d), GROUP)


def _class_columns(c: DataFrame) -> DataFrame:
    return c.select("user_id", "classification.state", "classification.tag", F.array_join("classification.tags", "|").alias("tags"))


@query("classify_group", _with(SQL) + _CLASSES + "SELECT * FROM classes")
def classify_group(spark, d: str) -> DataFrame:
    return _class_columns(_classified(spark, d))


@query("group_totals", _with(SQL) + _CLASSES + "SELECT state, count(*)::BIGINT AS n FROM classes GROUP BY state")
def group_totals(spark, d: str) -> DataFrame:
    return groups.totals(_classified(spark, d))


@query("group_problems", _with(SQL) + _CLASSES + "SELECT * FROM classes WHERE state <> 'tag'")
def group_problems(spark, d: str) -> DataFrame:
    return _class_columns(groups.problems(_classified(spark, d)))


@query("kanban_buckets", _with(SQL) + _CLASSES + "SELECT coalesce(tag, state) AS bucket, count(*)::BIGINT AS n FROM classes WHERE user_id % 6 <> 0 AND (user_id IN (SELECT user_id FROM a WHERE contains(lower(tag), 'sign')) OR user_id IN (SELECT user_id FROM manual WHERE contains(lower(tag), 'sign'))) GROUP BY 1")
def kanban_buckets(spark, d: str) -> DataFrame:
    shown = _classified(spark, d).filter(filters.view("auto_tagged") & filters.search(" SIGN"))
    return shown.groupBy(groups.bucket().alias("bucket")).agg(F.count("*").alias("n"))


_DROP = """, lists2 AS (SELECT user_id, manual_tags, coalesce((SELECT list(tag) FROM eff WHERE eff.user_id = lists.user_id), []) AS e FROM lists)"""


@query("apply_drop_tag", _with(SQL) + _DROP + """, s AS (
  SELECT user_id, e, list_filter(manual_tags, lambda x: x <> '-_reviewed') AS t FROM lists2
), s2 AS (
  SELECT user_id, e, CASE WHEN list_contains(t, '_reviewed') THEN t ELSE list_append(t, '_reviewed') END AS t FROM s
), s3 AS (
  SELECT user_id, CASE WHEN list_contains(e, 'error') THEN list_filter(t, lambda x: x <> 'error') ELSE t END AS t, list_contains(e, 'error') AS f FROM s2
)
SELECT user_id, array_to_string(CASE WHEN f AND NOT list_contains(t, '-error') THEN list_append(t, '-error') ELSE t END, '|') AS manual FROM s3""")  # fmt: skip
def apply_drop_tag(spark, d: str) -> DataFrame:
    return groups.apply_drop(records(spark, d), GROUP, "_reviewed").select("user_id", _joined("manual_tags").alias("manual"))


@query("apply_drop_unset", _with(SQL) + _DROP + """, s AS (
  SELECT user_id, e, CASE WHEN list_contains(e, '_reviewed') THEN list_append(list_filter(manual_tags, lambda x: x <> '_reviewed'), '-_reviewed') ELSE manual_tags END AS t FROM lists2
)
SELECT user_id, array_to_string(CASE WHEN list_contains(e, 'error') THEN list_append(list_filter(t, lambda x: x <> 'error'), '-error') ELSE t END, '|') AS manual FROM s""")  # fmt: skip
def apply_drop_unset(spark, d: str) -> DataFrame:
    return groups.apply_drop(records(spark, d), GROUP, None).select("user_id", _joined("manual_tags").alias("manual"))


@query("drop_then_classify", _with(SQL) + "SELECT user_id, 'tag' AS state, '_reviewed' AS tag FROM u")
def drop_then_classify(spark, d: str) -> DataFrame:
    return groups.classify(groups.apply_drop(records(spark, d), GROUP, "_reviewed"), GROUP).select("user_id", "classification.state", "classification.tag")


@query("mv_matches", _with(SQL) + "SELECT user_id FROM eff WHERE tag IN ('view', 'purchase') GROUP BY user_id HAVING count(*) = 2")
def mv_matches(spark, d: str) -> DataFrame:
    return groups.move_matches(records(spark, d), [" View", "PURCHASE", ""]).select("user_id")


# --- edits ---

_LISTED = _with(SQL)


@query("add_tag", _LISTED + """, s AS (SELECT user_id, manual_tags AS o, CASE WHEN list_contains(manual_tags, 'Purchase') THEN manual_tags ELSE list_append(manual_tags, 'Purchase') END AS t FROM lists), s2 AS (SELECT user_id, o, list_append(t, 'new') AS t FROM s)
SELECT user_id, array_to_string(t, '|') AS manual, len(t) <> len(o) AS changed FROM s2""")  # fmt: skip
def add_tag(spark, d: str) -> DataFrame:
    return edits.add_tags(records(spark, d), [" Purchase ", "", "new"]).select("user_id", _joined("manual_tags").alias("manual"), "changed")


@query("remove_tag_ci", _LISTED + "SELECT user_id, array_to_string(list_filter(manual_tags, lambda x: lower(trim(x)) NOT IN ('purchase', 'view')), '|') AS manual, len(list_filter(manual_tags, lambda x: lower(trim(x)) IN ('purchase', 'view')))::INTEGER AS removed FROM lists")
def remove_tag_ci(spark, d: str) -> DataFrame:
    return edits.remove_tags(records(spark, d), ["PURCHASE", "view"]).select("user_id", _joined("manual_tags").alias("manual"), "removed")


@query("suppress_tags", _LISTED + """SELECT user_id, array_to_string(CASE WHEN list_contains(manual_tags, '-error') THEN manual_tags ELSE list_append(manual_tags, '-error') END, '|') AS suppressed,
  array_to_string(list_filter(manual_tags, lambda x: x <> '-error'), '|') AS unsuppressed, array_to_string(CASE WHEN list_contains(manual_tags, '-error') THEN list_filter(manual_tags, lambda x: x <> '-error') ELSE list_append(manual_tags, '-error') END, '|') AS toggled, array_to_string(list_filter(manual_tags, lambda x: x <> 'Purchase'), '|') AS removed FROM lists""")  # fmt: skip
def suppress_tags(spark, d: str) -> DataFrame:
    m, e = F.col("manual_tags"), F.lit("error")
    return records(spark, d).select("user_id", *[F.array_join(x, "|").alias(n) for n, x in (("suppressed", edits.suppress(m, e)), ("unsuppressed", edits.unsuppress(m, e)), ("toggled", edits.toggle_suppression(m, e)), ("removed", edits.remove(m, F.lit("Purchase"))))])


@query("selection_edit", _LISTED + "SELECT user_id, array_to_string(CASE WHEN user_id % 2 = 0 THEN list_append(manual_tags, 'bulk') ELSE manual_tags END, '|') AS manual FROM lists")
def selection_edit(spark, d: str) -> DataFrame:
    r = records(spark, d)
    out = edits.on_selection(r, r.filter("user_id % 2 = 0"), edits.add_tags(r, ["bulk"]).drop("changed"))
    return out.select("user_id", _joined("manual_tags").alias("manual"))


@query("result_upsert", _with(SQL) + "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'fresh' ELSE string_agg(tag, '|' ORDER BY ord) END AS auto FROM auto GROUP BY user_id")
def result_upsert(spark, d: str) -> DataFrame:
    r = records(spark, d)
    fresh = r.filter("user_id % 3 = 0").select("sidecar_key", F.expr("array(named_struct('tag', 'fresh', 'score', cast(0.5 as float), 'category', 'general'))").alias("auto_tags"))
    return edits.upsert(r, fresh, ["auto_tags"]).select("user_id", F.array_join(F.transform("auto_tags", lambda x: x.tag), "|").alias("auto"))


@query("hint_edits", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN ' left is a ||right is b|new hint' ELSE 'new hint' END AS added, CASE WHEN user_id % 2 = 0 THEN ' left is a |' ELSE '' END AS removed FROM (SELECT DISTINCT user_id FROM events)")
def hint_edits(spark, d: str) -> DataFrame:
    h = F.col("caption_hints")
    return records(spark, d).select("user_id", F.array_join(edits.add_hint(h, F.lit(" new hint ")), "|").alias("added"), F.array_join(edits.remove_hint(h, F.lit("right is b")), "|").alias("removed"))


# --- captions ---


@query("export_caption", _with(CAPTIONS_SQL) + "SELECT conv_id, caption FROM caption")
def export_caption(spark, d: str) -> DataFrame:
    return conversations(spark, d).select("conv_id", captions.export_caption(F.col("manual_caption"), F.col("captions")).alias("caption"))


@query("build_caption_affix", _with(CAPTIONS_SQL) + "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'true to life, ' ELSE '' END || caption || CASE WHEN conv_id % 5 = 0 THEN ' At night.' ELSE '' END AS caption FROM caption")
def build_caption_affix(spark, d: str) -> DataFrame:
    p = ExportProfile(caption_prefixes={"realistic": "true to life, "}, caption_suffixes={"_night": " At night.", "day": " By day."})
    return conversations(spark, d).select("conv_id", captions.build_caption(p, F.col("manual_tags"), F.col("manual_caption"), F.col("captions")).alias("caption"))


@query("caption_model_counts", "SELECT role || '.' || turn AS model, count(*)::BIGINT AS n FROM conversations GROUP BY 1")
def caption_model_counts(spark, d: str) -> DataFrame:
    return stats.caption_models(conversations(spark, d))


@query("caption_edits", """SELECT conv_id, string_agg(role || '.' || turn, '|' ORDER BY role || '.' || turn) FILTER (role || '.' || turn <> 'user.0') || '' AS removed, bool_or(turn = 1 AND role = 'assistant') AS has_first, count(*) FILTER (turn % 3 = 2)::BIGINT + max(CASE WHEN role || '.' || turn = 'assistant.1' THEN 1 ELSE 0 END)::BIGINT AS skipped_after_toggle FROM conversations GROUP BY conv_id""")
def caption_edits(spark, d: str) -> DataFrame:
    c = conversations(spark, d)
    m = F.col("captions")
    toggled = edits.toggle_skip(m, F.lit("assistant.1"))
    return c.select("conv_id", F.nullif(F.array_join(F.array_sort(F.map_keys(edits.remove_caption(m, F.lit("user.0")))), "|"), F.lit("")).alias("removed"), F.map_contains_key("captions", "assistant.1").alias("has_first"), F.size(F.filter(F.map_values(toggled), lambda v: v.skip)).cast("long").alias("skipped_after_toggle"))


@query("promote_caption", _with(CAPTIONS_SQL) + """, f AS (SELECT conv_id, max(text) FILTER (role || '.' || turn = 'assistant.1') AS fresh FROM conversations GROUP BY conv_id), g AS (SELECT conv_id, manual, nullif(regexp_replace(fresh, '^[\\p{Z}\\s]+|[\\p{Z}\\s]+$', '', 'g'), '') AS fresh FROM man JOIN f USING (conv_id))
SELECT conv_id, manual AS never, coalesce(manual, fresh) AS if_empty, coalesce(fresh, manual) AS always FROM g""")  # fmt: skip
def promote_caption(spark, d: str) -> DataFrame:
    c = conversations(spark, d)
    return c.select("conv_id", *[edits.promote(m, F.col("manual_caption"), F.col("captions"), F.lit("assistant.1")).alias(m.replace("-", "_")) for m in ("never", "if-empty", "always")])


@query("caption_set", "SELECT conv_id, count(*)::BIGINT + max(CASE WHEN role || '.' || turn = 'user.0' THEN 0 ELSE 1 END) * (CASE WHEN bool_or(role || '.' || turn = 'user.0') THEN 0 ELSE 1 END)::BIGINT AS n, 'fresh' AS caption FROM conversations GROUP BY conv_id")
def caption_set(spark, d: str) -> DataFrame:
    m = edits.set_caption(F.col("captions"), F.lit("user.0"), F.lit("fresh"), F.lit(None).cast("timestamp"))
    return conversations(spark, d).select("conv_id", F.cardinality(m).cast("long").alias("n"), F.try_element_at(m, F.lit("user.0"))["caption"].alias("caption"))


@query("caption_hint_prompt", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN '- left is a' || chr(10) || '- right is b' END AS hints, CASE WHEN user_id % 2 = 0 THEN 'Use the following names and details when describing the image:' || chr(10) || '- left is a' || chr(10) || '- right is b' || chr(10) || chr(10) || 'Describe.' ELSE 'Describe.' END AS user_text FROM (SELECT DISTINCT user_id FROM events)")
def caption_hint_prompt(spark, d: str) -> DataFrame:
    hints = captions.hint_prompt(F.col("caption_hints"))
    return records(spark, d).select("user_id", hints.alias("hints"), captions.user_text(F.lit("Describe."), hints).alias("user_text"))


@query("pending_prompts", "SELECT doc_id, p.prompt FROM documents, (VALUES ('default'), ('character')) AS p(prompt) WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = doc_id AND c.role = 'user' AND c.turn = 0 AND p.prompt = 'default')")
def pending_prompts(spark, d: str) -> DataFrame:
    images = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sidecar_key"))
    # the derived caption key of a first user turn is model "user", prompt "0"; it's renamed to the default prompt here
    held = conversations(spark, d).withColumn("captions", F.transform_keys("captions", lambda k, v: F.when(k == "user.0", F.lit("user.default")).otherwise(k)))
    return filters.pending(images, held, "user", [("default", "Describe."), ("character", "Name them.")]).select("doc_id", "prompt")


@query("legacy_migration", """WITH l AS (SELECT conv_id, max(text) FILTER (turn = 0) AS caption, max(CASE WHEN conv_id % 2 = 0 THEN 'm' END) AS model, max(text) FILTER (turn = 1) AS hint FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(model, 'legacy') AS key, caption, len(list_filter(list_distinct(list_transform(string_split(hint, chr(10)), lambda x: trim(x))), lambda x: x <> ''))::BIGINT AS hints FROM l WHERE trim(caption) <> ''""")  # fmt: skip
def legacy_migration(spark, d: str) -> DataFrame:
    from loomset.sources.records import migrate

    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("caption"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("caption_hint"))
    legacy = c.select(F.col("conv_id").cast("string").alias("sidecar_key"), "conv_id", "caption", "caption_hint", F.when(F.col("conv_id") % 2 == 0, F.struct(F.lit("m").alias("model"), F.lit(None).cast("timestamp").alias("captioned_at"))).alias("captioner"))
    m = migrate(legacy).select("conv_id", F.explode("captions").alias("key", "c"), F.when(F.col("caption_hint_given"), F.size("caption_hints")).cast("long").alias("hints"))
    return m.select("conv_id", "key", "c.caption", "hints")


# --- metadata ---

_PAIRS = """, pair AS (SELECT u.user_id, '/data/' || u.user_id || '.png' AS image_path, nullif((SELECT string_agg(replace(shown, '_', ' '), ', ' ORDER BY src, ord) FROM first WHERE first.user_id = u.user_id), '') AS tags, c.caption FROM u LEFT JOIN caption c ON c.conv_id = u.user_id)"""


def _paired(spark, d: str) -> DataFrame:
    text = tags.export_text(records(spark, d), ANIMA).select("user_id", F.nullif("text", F.lit("")).alias("tags"))
    body = conversations(spark, d).select(F.col("conv_id").alias("user_id"), captions.export_caption(F.col("manual_caption"), F.col("captions")).alias("caption"))
    return text.join(body, "user_id", "left").withColumn("image_path", F.concat(F.lit("/data/"), F.col("user_id").cast("string"), F.lit(".png")))


@query("meta_sd_scripts", _with(SQL, exported(), CAPTIONS_SQL) + _PAIRS + """SELECT image_path, '{' || concat_ws(',', CASE WHEN caption IS NOT NULL THEN '"caption":' || to_json(caption) END, CASE WHEN tags IS NOT NULL THEN '"tags":' || to_json(tags) END) || '}' AS entry FROM pair WHERE caption IS NOT NULL OR tags IS NOT NULL""")
def meta_sd_scripts(spark, d: str) -> DataFrame:
    from loomset.sources.sinks import sd_scripts_entries

    return sd_scripts_entries(_paired(spark, d))


@query("meta_musubi", _with(SQL, exported(), CAPTIONS_SQL) + _PAIRS + """SELECT '{"caption":' || to_json(caption) || ',"image_path":' || to_json(image_path) || '}' AS value FROM pair WHERE caption IS NOT NULL""")
def meta_musubi(spark, d: str) -> DataFrame:
    from loomset.sources.sinks import musubi_lines

    return musubi_lines(_paired(spark, d))


# --- predicates and counts ---


@query("status_flags", """SELECT d.doc_id, '[' || CASE WHEN l.doc_id IS NULL THEN ' ' ELSE 'T' END || CASE WHEN c.conv_id IS NULL THEN ' ' ELSE 'C' END || CASE WHEN d.doc_id % 4 = 1 THEN 'B' ELSE ' ' END || '] manual=' || (SELECT count(*) FROM (VALUES (3), (4), (5), (7)) AS m(m) WHERE d.doc_id % m = 0) || ' /data/' || d.doc_id || '.png' AS line
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) c ON c.conv_id = d.doc_id""")  # fmt: skip
def status_flags(spark, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id").distinct().withColumn("tagger", F.lit("t"))
    held = docs.join(labels, "doc_id", "left").join(conversations(spark, d).select(F.col("conv_id").alias("doc_id"), "captions"), "doc_id", "left")
    manual = F.filter(F.array(*[F.when(F.col("doc_id") % m == 0, F.lit(t)) for _, m, t in MANUAL]), lambda t: t.isNotNull())
    path = F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return held.select("doc_id", stats.flags(F.col("tagger"), F.col("captions"), F.when(F.col("doc_id") % 4 == 1, 1), manual, path).alias("line"))


@query("gui_filters", _with(SQL) + """SELECT v.view, count(*) FILTER (CASE v.view WHEN 'all' THEN true WHEN 'untagged' THEN user_id % 6 = 0 AND len(manual_tags) = 0 WHEN 'auto_tagged' THEN user_id % 6 <> 0 WHEN 'no_manual' THEN len(manual_tags) = 0 WHEN 'no_caption' THEN true WHEN 'no_hint' THEN user_id % 2 <> 0 WHEN 'no_booru' THEN user_id % 4 = 1 END)::BIGINT AS n
FROM lists, (VALUES ('all'), ('untagged'), ('auto_tagged'), ('no_manual'), ('no_caption'), ('no_hint'), ('no_booru')) AS v(view) GROUP BY v.view""")  # fmt: skip
def gui_filters(spark, d: str) -> DataFrame:
    one = records(spark, d).agg(*[F.count_if(filters.view(v)).alias(v) for v in filters.VIEWS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("n")) for v in filters.VIEWS])).alias("x")).select("x.view", "x.n")


@query("tag_search", _with(SQL) + "SELECT user_id FROM u WHERE user_id IN (SELECT user_id FROM a WHERE contains(lower(tag), '-err')) OR user_id IN (SELECT user_id FROM manual WHERE contains(lower(tag), '-err'))")
def tag_search(spark, d: str) -> DataFrame:
    return records(spark, d).filter(filters.search(" -ERR ")).select("user_id")


@query("common_tags", _with(SQL) + "SELECT min(tag) AS tag, count(DISTINCT user_id)::BIGINT AS n FROM (SELECT user_id, tag FROM a UNION ALL SELECT user_id, tag FROM booru) GROUP BY lower(tag) HAVING count(DISTINCT user_id) >= 2")
def common_tags(spark, d: str) -> DataFrame:
    return stats.common_tags(records(spark, d))


@query("manual_coverage", _with(SQL) + "SELECT tag AS value, count(*)::BIGINT AS n, count(*) / (SELECT count(*) FROM u) AS share FROM manual GROUP BY tag")
def manual_coverage(spark, d: str) -> DataFrame:
    return stats.coverage(records(spark, d), "manual_tags")


@query("hint_coverage", _with(SQL) + "SELECT h.v AS value, count(*)::BIGINT AS n, count(*) / (SELECT count(*) FROM u) AS share FROM u, (VALUES (' left is a '), (''), ('right is b')) AS h(v) WHERE user_id % 2 = 0 GROUP BY 1")
def hint_coverage(spark, d: str) -> DataFrame:
    return stats.coverage(records(spark, d), "caption_hints")


@query("run_counters", "SELECT CASE WHEN user_id % 6 <> 0 THEN 'skipped' ELSE 'tagged' END AS outcome, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def run_counters(spark, d: str) -> DataFrame:
    return stats.run_counts(records(spark, d).select(F.when(filters.tagged(), "skipped").otherwise("tagged").alias("outcome")))


_TOKENS = r"len(regexp_extract_all(text, '\S+'))::BIGINT"


@query("token_percentiles", f"""WITH t AS (SELECT {_TOKENS} AS n, row_number() OVER (ORDER BY {_TOKENS}) - 1 AS i, count(*) OVER () AS c FROM documents)
SELECT max(n) FILTER (i = round((c - 1)::FLOAT * 0.5::FLOAT)) AS p50, max(n) FILTER (i = round((c - 1)::FLOAT * 0.9::FLOAT)) AS p90, max(n) FILTER (i = round((c - 1)::FLOAT * 0.99::FLOAT)) AS p99, max(n) AS max, count(*)::BIGINT AS n FROM t""")  # fmt: skip
def token_percentiles(spark, d: str) -> DataFrame:
    counted = table(spark, d, "documents").select(F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("total"))
    return stats.nearest_rank(counted, "total", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("token_overflow", f"SELECT doc_id, {_TOKENS} AS total FROM documents WHERE {_TOKENS} > 512")
def token_overflow(spark, d: str) -> DataFrame:
    return stats.over_budget(table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("total")), "total")


#: A public tokenizer's file; operators take any path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _budget(spark, d: str) -> DataFrame:
    """Users' records with the captions of the conversation of the same number."""
    told = conversations(spark, d).select(F.col("conv_id").alias("user_id"), F.col("captions").alias("_c"), F.col("manual_caption").alias("_m"))
    both = records(spark, d).drop("captions", "manual_caption").join(told, "user_id", "left")
    return token_budget.budget(both.withColumnsRenamed({"_c": "captions", "_m": "manual_caption"}), ANIMA, TOKENIZER, "user_id")


@query("token_budget")
def token_budget_(spark, d: str) -> DataFrame:
    """Tokens of tags and caption, apart and in all."""
    return _budget(spark, d)


@query("budget_percentiles")
def budget_percentiles(spark, d: str) -> DataFrame:
    return stats.nearest_rank(_budget(spark, d), "total", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("tag_search_postings", _with(SQL) + "SELECT user_id FROM u WHERE (user_id IN (SELECT user_id FROM a WHERE contains(lower(tag), 'urch')) OR user_id IN (SELECT user_id FROM manual WHERE contains(lower(tag), 'urch'))) AND user_id IN (SELECT user_id FROM manual WHERE contains(lower(tag), '-err'))")
def tag_search_postings(spark, d: str) -> DataFrame:
    """Records with tags that contain both needles, by postings that were built of half of the records and updated with all."""
    held = records(spark, d)
    index = postings.Postings(spark, f"{shared_dir(spark)}/loomset/postings-{uuid.uuid4().hex}", "user_id")
    index.update(held.filter("user_id % 2 = 0"))
    index.update(held)
    return index.search(" URCH", "-Err")


@query("edit_log", _with(SQL) + """SELECT u.user_id, CASE WHEN u.user_id % 4 = 0 THEN 'changed' WHEN u.user_id % 3 = 0 THEN 'overtaken' END AS lost,
  CASE WHEN u.user_id % 4 <> 0 THEN array_to_string(list_concat(list_filter(manual_tags, lambda t: lower(trim(t)) <> 'purchase'), ['kept', '-blur']), '|') END AS tags FROM u JOIN lists USING (user_id)""")
def edit_log(spark, d: str) -> DataFrame:
    """A log over all records: those of stale versions come back, and so does the second of two batches for one version."""
    held = records(spark, d).withColumn("digest", F.md5(F.array_join("manual_tags", "|")))
    step = lambda batch, seq, op, value: F.struct(F.lit(batch).cast("long").alias("batch"), F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(value).alias("value"))
    first = F.array(step(1, 1, "add", "kept"), step(1, 2, "remove", "PURCHASE "), step(1, 3, "suppress", "blur"))
    steps = F.explode(F.when(F.col("user_id") % 3 == 0, F.concat(first, F.array(step(2, 1, "add", "late")))).otherwise(first))
    expected = F.when(F.col("user_id") % 4 == 0, "another").otherwise(F.col("digest"))
    log = held.select("sidecar_key", expected.alias("expected"), steps.alias("s")).select("s.batch", "sidecar_key", "expected", "s.seq", "s.op", "s.value")
    edited, conflicts = versions.apply(held, log)
    lost = conflicts.groupBy("sidecar_key").agg(F.min("reason").alias("lost"))
    return held.select("user_id", "sidecar_key").join(edited.select("sidecar_key", _joined("manual_tags").alias("tags")), "sidecar_key", "left").join(lost, "sidecar_key", "left").select("user_id", "lost", "tags")


# --- lookups, plans and small functions ---


@query("md5_lookup", "SELECT p.page_id, md5(p.html) AS md5, q.post_id FROM pages p LEFT JOIN (SELECT md5(html) AS md5, min(page_id) AS post_id FROM pages WHERE page_id % 2 = 0 GROUP BY 1) q ON q.md5 = md5(p.html)")
def md5_lookup(spark, d: str) -> DataFrame:
    from loomset.sources.booru import lookup

    pages = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.md5(F.encode("html", "UTF-8")).alias("key"))
    posts = pages.filter("page_id % 2 = 0").groupBy(F.col("key").alias("md5")).agg(F.min("page_id").alias("post_id"))
    return lookup(pages, posts).select("page_id", "md5", "post_id")


@query("booru_post_tags", "SELECT user_id, string_agg(category || ':' || event_type, '|' ORDER BY o, event_type) AS tags FROM (SELECT DISTINCT user_id, event_type, CASE event_type WHEN 'error' THEN 'meta' WHEN 'purchase' THEN 'character' WHEN 'click' THEN 'artist' ELSE 'general' END AS category, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 4 END AS o FROM events) GROUP BY user_id")
def booru_post_tags(spark, d: str) -> DataFrame:
    from loomset.sources.booru import FIELDS, post_tags

    e = table(spark, d, "events").select("user_id", "event_type", F.expr("CASE event_type WHEN 'error' THEN 'meta' WHEN 'purchase' THEN 'character' WHEN 'click' THEN 'artist' ELSE 'general' END").alias("c")).distinct()
    posts = e.groupBy("user_id").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.col("event_type")))), "  ").alias(f"tag_string_{c}") for c in FIELDS])
    return posts.select("user_id", F.array_join(F.transform(post_tags(), lambda t: F.concat(t.category, F.lit(":"), t.tag)), "|").alias("tags"))


@query("category_names", "SELECT l_linenumber AS id, CASE l_linenumber WHEN 0 THEN 'general' WHEN 1 THEN 'artist' WHEN 3 THEN 'copyright' WHEN 4 THEN 'character' WHEN 5 THEN 'meta' WHEN 9 THEN 'rating' ELSE 'category_' || l_linenumber END AS name, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def category_names(spark, d: str) -> DataFrame:
    from loomset.sources.tagdict import category_name

    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("id")).agg(F.count("*").alias("n")).select("id", category_name(F.col("id")).alias("name"), "n")


@query("image_paths", """WITH p AS (SELECT page_id, '/d/' || page_id % 10 || '/x.' || page_id || '.' || CASE page_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'txt' ELSE 'webp' END AS path FROM pages)
SELECT page_id, '/d/' || page_id % 10 || '/x.' || page_id AS sidecar_key, CASE page_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/webp' END AS mime, page_id % 10 || '/x.' || page_id || '.txt' AS text_path FROM p WHERE page_id % 4 <> 2""")  # fmt: skip
def image_paths(spark, d: str) -> DataFrame:
    ext = F.expr("CASE page_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'txt' ELSE 'webp' END")
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("/d/"), (F.col("page_id") % 10).cast("string"), F.lit("/x."), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"))
    path = F.col("path")
    return p.filter(paths.is_image(path)).select("page_id", paths.sidecar_key(path).alias("sidecar_key"), paths.mime(path).alias("mime"), paths.with_extension(paths.relative(path, "/d"), "txt").alias("text_path"))


@query("resize_plan", """WITH s AS (SELECT p_partkey, (p_size * 37 + 5)::BIGINT AS h, (p_partkey * 13 % 3000 + 1)::BIGINT AS w FROM part), r AS (
  SELECT *, greatest(round(h / 32.0::DOUBLE)::BIGINT * 32, 32) AS nh, greatest(round(w / 32.0::DOUBLE)::BIGINT * 32, 32) AS nw FROM s), q AS (
  SELECT *, sqrt(h::DOUBLE * w / 589824) AS down, sqrt(1024.0::DOUBLE / (h::DOUBLE * w)) AS up FROM r)
SELECT p_partkey, (CASE WHEN nh * nw > 589824 THEN greatest(floor(greatest(h / down, 1))::BIGINT // 32 * 32, 32) WHEN nh * nw < 1024 THEN greatest(ceil(floor(h * up) / 32.0)::BIGINT * 32, 32) ELSE nh END)::INTEGER AS h2,
  (CASE WHEN nh * nw > 589824 THEN greatest(floor(greatest(w / down, 1))::BIGINT // 32 * 32, 32) WHEN nh * nw < 1024 THEN greatest(ceil(floor(w * up) / 32.0)::BIGINT * 32, 32) ELSE nw END)::INTEGER AS w2,
  (CASE WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(round((w::FLOAT * (1024::FLOAT / greatest(w, h)::FLOAT)::FLOAT)::FLOAT)::INTEGER, 1) END)::INTEGER AS fit_w FROM q""")  # fmt: skip
def resize_plan(spark, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 5).cast("long").alias("h"), (F.col("p_partkey") * 13 % 3000 + 1).cast("long").alias("w"))
    r = paths.smart_resize(F.col("h"), F.col("w"))
    return s.select("p_partkey", r["h"].alias("h2"), r["w"].alias("w2"), paths.fit_max_edge(F.col("w"), F.col("h"), 1024)["w"].alias("fit_w"))


@query("retry_backoff", "SELECT DISTINCT p_size AS attempt, least(2 ** least(p_size - 1, 10), 30)::BIGINT AS seconds FROM part")
def retry_backoff(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_size").alias("attempt")).distinct().select("attempt", paths.backoff_seconds(F.col("attempt")).alias("seconds"))


@query("url_encoded", "SELECT page_id, replace(url_encode(url || ' ~*é+'), '%2F', '/') AS encoded FROM pages")
def url_encoded(spark, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", paths.percent_encode(F.concat("url", F.lit(" ~*é+"))).alias("encoded"))


@query("data_urls", "SELECT page_id, 'data:image/png;base64,' || to_base64(encode(html)) AS url FROM pages")
def data_urls(spark, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", paths.data_url(F.lit("a.PNG"), F.encode("html", "UTF-8")).alias("url"))
    return p.withColumn("url", F.regexp_replace("url", "[\r\n]", ""))


@query("upscale_plan", "SELECT '/in/' || doc_id || CASE WHEN k = 1 THEN '.png' ELSE '.jpg' END AS src, '/in/out/' || doc_id || '.png' AS dst, CASE WHEN doc_id % 5 = 0 OR k = 1 THEN 'skip' ELSE 'upscale' END AS action FROM documents, (VALUES (0), (1)) AS t(k)")
def upscale_plan(spark, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("i"), "doc_id")
    images = ids.select(F.explode(F.array(F.concat(F.lit("/in/"), "i", F.lit(".jpg")), F.concat(F.lit("/in/"), "i", F.lit(".png")), F.concat(F.lit("/in/out/"), "i", F.lit(".bmp")))).alias("image_path"))
    existing = ids.filter("doc_id % 5 = 0").select(F.concat(F.lit("/in/out/"), "i", F.lit(".png")).alias("image_path"))
    return filters.upscale_plan(images, existing, "/in", "/in/out")


@query("move_plan", _with(SQL) + "SELECT '/src/' || user_id || '.png' AS src, '/dst/' || user_id || '.png' AS dst, user_id % 6 <> 0 AS has_record, CASE WHEN user_id % 10 = 0 OR (user_id % 6 <> 0 AND user_id % 15 = 0) THEN 'skip' ELSE 'move' END AS action FROM (SELECT user_id FROM eff WHERE tag = 'view')")
def move_plan(spark, d: str) -> DataFrame:
    r = records(spark, d)
    path = lambda base, ext: F.concat(F.lit(f"/{base}/"), F.col("user_id").cast("string"), F.lit(ext))
    matches = groups.move_matches(r, ["view"]).select(path("src", ".png").alias("image_path"), filters.tagged().alias("has_record"))
    there = r.filter("user_id % 10 = 0").select(path("dst", ".png").alias("image_path"), path("dst", "").alias("sidecar_key"), F.lit(False).alias("has_record"))
    held = r.filter("user_id % 15 = 0").select(path("dst", ".jpg").alias("image_path"), path("dst", "").alias("sidecar_key"), F.lit(True).alias("has_record"))
    return filters.move_plan(matches, there.unionByName(held), "/src", "/dst")


@query("spaced_tags", "SELECT doc_id, replace(source, '_', ' ') || ', ' || replace(lang || '_x', '_', ' ') AS line FROM documents")
def spaced_tags(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", spaced(F.array(F.col("source"), F.concat("lang", F.lit("_x")))).alias("line"))
