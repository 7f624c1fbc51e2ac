"""Registered jobs: AI result documents, AI calls, content hashes."""

from pyspark.sql import functions as F

from harness.registry import job
from mediaops.functions import columns as fn
from mediaops.operators import results

PARSED = r"""
, p AS (SELECT doc_id, result, regexp_replace(regexp_replace(result, '^```(json)?\n?', ''), '\n?```$', '') AS t FROM fx_results)
, j AS (SELECT doc_id, result, TRY_CAST(t AS JSON) AS d FROM p)
"""


def _parsed(v):
    return results.parse_results(v("fx_results"))


@job("parse_results", "fx_results", PARSED + """
SELECT doc_id, d IS NOT NULL AS parsed, d ->> '$.summary' AS summary, d ->> '$.sentiment' AS sentiment, d ->> '$.textDetected' AS text_detected,
  CAST(json_array_length(d, '$.scenes') AS INT) AS n_scenes, d ->> '$.tags[0]' AS first_tag, length(result) AS raw_length FROM j""")
def _(v):
    return _parsed(v).select(
        "doc_id", "parsed", "doc.summary", "doc.sentiment", F.col("doc.textDetected").alias("text_detected"),
        F.size("doc.scenes").alias("n_scenes"), F.get("doc.tags", 0).alias("first_tag"),
        F.length("result").cast("long").alias("raw_length"),
    )


@job("extract_summary", "fx_results", PARSED + """
SELECT doc_id, coalesce(d ->> '$.summary', left(result, 200)) AS summary, coalesce(d ->> '$.summary', left(result, 200)) AS by_pattern FROM j""")
def _(v):
    return v("fx_results").select(
        "doc_id", fn.summary_of(F.col("result")).alias("summary"),
        fn.summary_of(F.col("result"), by_pattern_only=True).alias("by_pattern"),
    )


SCENES = PARSED + """
, s AS (SELECT doc_id, CAST(g.i AS INT) AS place, coalesce(json_extract_string(d, '$.scenes[' || g.i || '].timeRange'), '-') AS time_range,
  json_extract_string(d, '$.scenes[' || g.i || '].description') AS description, json_extract_string(d, '$.scenes[' || g.i || '].type') AS type
  FROM j, generate_series(0, 5) AS g(i) WHERE g.i < json_array_length(d, '$.scenes'))
"""


@job("scenes", "fx_results", SCENES + """
SELECT * FROM s UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM j WHERE d IS NULL""")
def _(v):
    return results.scenes(_parsed(v)).drop("result")


@job("keyframes", "fx_results", PARSED + """
SELECT doc_id, CAST(CASE WHEN d IS NOT NULL THEN 0 END AS INT) AS place, d ->> '$.keyframes[0].time' AS time, d ->> '$.keyframes[0].description' AS description FROM j""")
def _(v):
    return results.keyframes(_parsed(v)).drop("result")


@job("scene_durations", "fx_results", SCENES + """
, t AS (SELECT type, string_split(time_range, '-') AS r FROM s)
SELECT type, count(*) AS scenes, CAST(sum(
  TRY_CAST(string_split(r[2], ':')[1] AS INT) * 60 + TRY_CAST(string_split(r[2], ':')[2] AS INT) - TRY_CAST(string_split(r[1], ':')[1] AS INT) * 60 - TRY_CAST(string_split(r[1], ':')[2] AS INT))
  FILTER (WHERE r[1] <> '') AS BIGINT) AS seconds FROM t GROUP BY type""")
def _(v):
    return results.scene_durations(results.scenes(_parsed(v)))


@job("sentiment_mix", "fx_results", PARSED + """
SELECT CASE WHEN contains(d ->> '$.sentiment', '正') OR contains(lower(d ->> '$.sentiment'), 'positive') THEN 'positive'
  WHEN contains(d ->> '$.sentiment', '负') OR contains(lower(d ->> '$.sentiment'), 'negative') THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n
FROM j WHERE d IS NOT NULL GROUP BY 1""")
def _(v):
    return results.sentiment_mix(_parsed(v))


@job("detected_text", "fx_results", PARSED + """
SELECT doc_id, d ->> '$.textDetected' AS text_detected FROM j WHERE d ->> '$.textDetected' <> ''""")
def _(v):
    return results.detected_text(_parsed(v)).drop("result")


@job("top_tags", "fx_results", PARSED + """
SELECT tag, count(*) AS n FROM (SELECT unnest(CAST(d -> '$.tags' AS VARCHAR[])) AS tag FROM j WHERE d IS NOT NULL) GROUP BY tag ORDER BY n DESC, tag LIMIT 5""")
def _(v):
    return results.top_tags(_parsed(v), k=5)


class ScriptedClient:
    """Answers by the number in the url, the same on every run: always refused by code, refused twice by
    the message, broken, raising, or fine."""

    def __init__(self):
        self.calls = {}

    def __call__(self, url, prompt):
        number = int(url.rsplit("_", 1)[1].split(".")[0])
        seen = self.calls[url] = self.calls.get(url, 0) + 1
        if number % 7 == 0:
            return results.Answer(429, "busy")
        if number % 7 == 1 and seen <= 2:
            return results.Answer(500, "over the rate")
        if number % 7 == 2:
            return results.Answer(500, str(number))
        if number % 7 == 3:
            raise ValueError(f"no line to {number}")
        return results.Answer(200, None, f"{number}: {prompt}")


@job("enrich_with_retry", "fx_tasks", r"""
SELECT task_id, id % 7 NOT IN (0, 2, 3) AS ok, CASE id % 7 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS attempts,
  CASE WHEN id % 7 NOT IN (0, 2, 3) THEN CAST(id AS VARCHAR) || ': ' || CASE WHEN regexp_matches(prompt, '\S') THEN prompt ELSE '请分析这个视频的内容，按照系统提示的JSON格式返回结果。' END END AS result,
  CASE id % 7 WHEN 0 THEN 'AI call failed after 3 retries' WHEN 2 THEN 'AI call failed: code=500, msg=' || CAST(id AS VARCHAR)
    WHEN 3 THEN 'AI call failed: no line to ' || CAST(id AS VARCHAR) END AS error FROM fx_tasks""")
def _(v):
    done = results.enrich_with_retry(v("fx_tasks"), ScriptedClient(), delays=(0, 0, 0), parallelism=v.cores)
    ok, failed = results.split_outcomes(done)
    return ok.unionByName(failed)


@job("verify_content", "fx_upload_requests", """
SELECT CAST(r.request_id AS VARCHAR) AS upload_id, r.file_hash, md5(d.text) AS actual_hash,
  CASE WHEN d.doc_id IS NULL THEN 'NO_CONTENT' WHEN r.file_hash IS NULL THEN 'NOT_DECLARED' WHEN lower(r.file_hash) = md5(d.text) THEN 'MATCH' ELSE 'MISMATCH' END AS outcome
FROM fx_upload_requests r LEFT JOIN documents d ON r.request_id = d.doc_id AND d.doc_id % 50 <> 0""")
def _(v):
    sessions = v("fx_upload_requests").select(F.col("request_id").cast("string").alias("upload_id"), "file_hash")
    # some contents lie under a key that no session has
    kept_under = F.concat(F.when(F.col("doc_id") % 50 == 0, "moved_").otherwise(""), F.col("doc_id").cast("string"))
    content = v("documents").select(kept_under.alias("upload_id"), "text")
    return results.verify_content(content, sessions, F.md5("text"))
