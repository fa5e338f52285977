"""Score rows: an embedding's 64 values play the scores of ids 0 to 63; ids from 48 on are times, 40 is the end token."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups
from ..operators import decoding as D
from ..operators import search
from ..operators.text import ladder
from ..scratch import scratch
from ..tables import table
from .catalog import query
from .views import TENSOR, TOKENS, tensor, tokens

END, TIMES = 40, 48
R = lambda c: F.round(c, 6)
SCORES = TENSOR.replace("tensor AS", "raw AS", 1) + ", scores AS (SELECT vec_id, label, CAST(pos AS BIGINT) AS id, v * 10 AS v FROM raw)"
LOGP = SCORES + ", top AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM scores), lp AS (SELECT vec_id, label, id, v - m - ln(sum(exp(v - m)) OVER (PARTITION BY vec_id)) AS v FROM top)"


def scores(spark, d):
    return tensor(spark, d).select("vec_id", "label", F.col("pos").cast("long").alias("id"), (F.col("v") * 10).alias("v"))


def logp(spark, d):
    return D.log_softmax(scores(spark, d), ["vec_id"])


@query("softmax", f"WITH {SCORES}, e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM scores) SELECT vec_id, id, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e")
def softmax(spark, d):
    return D.softmax(scores(spark, d), ["vec_id"]).select("vec_id", "id", R("v").alias("p"))


@query("log_softmax", f"WITH {LOGP} SELECT vec_id, id, round(v, 6) AS v FROM lp")
def log_softmax(spark, d):
    return logp(spark, d).select("vec_id", "id", R("v").alias("v"))


@query("topk_logits", f"WITH {LOGP}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id) AS k FROM lp) SELECT vec_id, CAST(k AS INT) AS rank, id, round(v, 6) AS v FROM r WHERE k <= 5")
def topk_logits(spark, d):
    return D.top_k(logp(spark, d), ["vec_id"], 5).select("vec_id", "rank", "id", R("v").alias("v"))


@query("argmax_last_tie", f"WITH {SCORES}, q AS (SELECT vec_id, id, round(v, 0) AS v FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id DESC) AS k FROM q) SELECT vec_id, id, v + 0.0 AS v FROM r WHERE k = 1")
def argmax_last_tie(spark, d):
    return D.argmax_last(scores(spark, d).withColumn("v", F.round("v", 0)), ["vec_id"]).select("vec_id", "id", (F.col("v") + 0.0).alias("v"))


@query("entropy", f"WITH {LOGP} SELECT vec_id, round(-sum(exp(v) * v), 6) AS entropy FROM lp GROUP BY vec_id")
def entropy(spark, d):
    return D.entropy(logp(spark, d), ["vec_id"]).select("vec_id", R("entropy").alias("entropy"))


@query("nospeech_prob", f"WITH {LOGP} SELECT vec_id, round(exp(v), 6) AS p FROM lp WHERE id = 44")
def nospeech_prob(spark, d):
    return logp(spark, d).where("id = 44").select("vec_id", R(F.exp("v")).alias("p"))


@query(
    "lang_detect",
    f"""WITH {SCORES}, l AS (SELECT vec_id, id, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM scores WHERE id BETWEEN 10 AND 13), p AS (SELECT vec_id, id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, id DESC) AS k FROM p) SELECT vec_id, ['en', 'zh', 'de', 'es'][id - 9] AS lang, round(p, 6) AS p FROM r WHERE k = 1""",
)
def lang_detect(spark, d):
    p = D.softmax(scores(spark, d).where("id between 10 and 13"), ["vec_id"])
    names = F.broadcast(lookups.languages(spark).select((F.col("id") + 10).cast("long").alias("id"), F.col("code").alias("lang")))
    return D.argmax_last(p, ["vec_id"]).join(names, "id").select("vec_id", "lang", R("v").alias("p"))


@query(
    "temperature_sample",
    f"""WITH {SCORES}, e AS (SELECT vec_id, id, exp(v / 0.8 - max(v / 0.8) OVER (PARTITION BY vec_id)) AS e FROM scores), p AS (SELECT vec_id, id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM p) SELECT vec_id, coalesce(min(CASE WHEN c >= 0.37 THEN id END), max(id)) AS id FROM c GROUP BY vec_id""",
)
def temperature_sample(spark, d):
    return D.sample(scores(spark, d), ["vec_id"], 0.8, F.lit(0.37))


@query("suppress_specials", f"WITH {SCORES} SELECT vec_id, id, round(coalesce(CASE WHEN id > {END} AND id < {TIMES} THEN NULL ELSE v END, -9999.0), 6) AS v FROM scores")
def suppress_specials(spark, d):
    return scores(spark, d).select("vec_id", "id", R(F.coalesce(D.suppress_specials(F.col("id"), F.col("v"), END, TIMES), F.lit(-9999.0))).alias("v"))


@query(
    "suppress_nonspeech",
    "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), n AS (SELECT DISTINCT word FROM w WHERE trim(word) <> '' AND NOT regexp_matches(word, '[\\p{L}\\p{N}]')) SELECT doc_id, count(*) AS kept, count(DISTINCT word) AS words FROM w WHERE word NOT IN (SELECT word FROM n) GROUP BY doc_id",
)
def suppress_nonspeech(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return w.where(~D.is_non_speech(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.countDistinct("word").alias("words"))


@query(
    "grammar_mask",
    f"""WITH {SCORES}, c AS (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS t FROM benchmark), p AS (SELECT DISTINCT substr(t, 1, CAST(n AS BIGINT)) AS prefix FROM (SELECT t, unnest(range(0, length(t) + 1)) AS n FROM c)),
s AS (SELECT *, chr(CAST(97 + id % 26 AS INT)) || CASE WHEN id % 2 = 0 THEN 'h' ELSE '' END AS piece FROM scores) SELECT vec_id, id, round(CASE WHEN id >= {END} OR piece IN (SELECT prefix FROM p) THEN v ELSE v - 100 END, 6) AS v FROM s""",
)
def grammar_mask(spark, d):
    allowed = D.prefixes(table(spark, d, "benchmark").select(F.lower(F.split("text", " ")[0]).alias("t")).distinct(), "t")
    s = scores(spark, d).withColumn("piece", F.concat(F.chr((97 + F.col("id") % 26).cast("int")), F.when(F.col("id") % 2 == 0, "h").otherwise("")))
    return D.grammar_penalty(s, allowed, "piece", 100.0, F.col("id") >= END).select("vec_id", "id", R("v").alias("v"))


@query(
    "timestamp_rules",
    f"""WITH {TOKENS}, l AS (SELECT *, lag(is_ts) OVER w AS a, lag(is_ts, 2, true) OVER w AS b, max(CASE WHEN is_ts THEN tok END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM tokens WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, coalesce(a AND b, false) AS no_time, coalesce(a AND NOT b, false) AS no_text, coalesce(m + CASE WHEN coalesce(a AND NOT b, false) THEN 0 ELSE 1 END, -1) AS least FROM l""",
)
def timestamp_rules(spark, d):
    return D.pairing(tokens(spark, d), ["user_id"], "i", "is_ts").select("user_id", "i", "no_time", "no_text", F.coalesce("least", F.lit(-1)).alias("least"))


@query(
    "timestamp_mass",
    f"WITH {SCORES}, a AS (SELECT vec_id, max(v) FILTER (id >= {TIMES}) AS m, max(v) FILTER (id < {TIMES}) AS t FROM scores GROUP BY vec_id), b AS (SELECT s.vec_id, max(m) + ln(sum(exp(v - m))) AS tm, max(t) AS t FROM scores s JOIN a USING (vec_id) WHERE id >= {TIMES} GROUP BY s.vec_id) SELECT vec_id, round(tm, 6) AS time, round(t, 6) AS text, tm > t AS text_forbidden FROM b",
)
def timestamp_mass(spark, d):
    return D.times_outweigh_text(scores(spark, d), ["vec_id"], F.col("id") >= TIMES).select("vec_id", R("time").alias("time"), R("text").alias("text"), "text_forbidden")


@query(
    "best_of_n",
    f"WITH {LOGP}, s AS (SELECT label, vec_id, round(avg(v), 2) AS score FROM lp GROUP BY label, vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s) SELECT label, vec_id, score FROM r WHERE k = 1",
)
def best_of_n(spark, d):
    s = logp(spark, d).groupBy("label", "vec_id").agg(F.round(F.avg("v"), 2).alias("score"))
    return D.best_attempt(s, ["label"], "score", "vec_id")


@query(
    "fallback_ladder",
    "WITH e AS (SELECT user_id, CAST(event_id % 6 AS BIGINT) AS rung, avg(value) AS score, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT user_id, coalesce(min(CASE WHEN score > 120 THEN rung END), max(rung)) AS rung FROM e GROUP BY user_id) SELECT e.user_id, e.rung, round(score, 6) AS score, n FROM e JOIN a USING (user_id, rung)",
)
def fallback_ladder(spark, d):
    e = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 6).alias("rung")).agg(F.avg("value").alias("score"), F.count("*").alias("n"))
    return D.fallback(e.withColumn("ok", F.col("score") > 120), ["user_id"], "rung", "ok").select("user_id", "rung", R("score").alias("score"), "n")


@query(
    "quality_gates",
    "WITH g AS (SELECT doc_id, length(text) / CAST(greatest(len(list_distinct(string_split(text, ' '))), 1) AS DOUBLE) / 4 AS ratio, -(doc_id % 17) / 10.0 AS lp, (doc_id % 31) / 6.0 AS ent, (doc_id % 10) / 9.0 AS ns FROM documents) SELECT doc_id, round(ratio, 6) AS ratio, ratio < 2.4 AND lp > -1 AND ent > 2.4 AS passed, ns > 0.6 AND lp < -1 AS silence FROM g",
)
def quality_gates(spark, d):
    words = F.size(F.array_distinct(F.split("text", " ")))
    ratio, lp, ent, ns = F.length("text") / words.cast("double") / 4, -(F.col("doc_id") % 17) / 10.0, (F.col("doc_id") % 31) / 6.0, (F.col("doc_id") % 10) / 9.0
    return table(spark, d, "documents").select("doc_id", R(ratio).alias("ratio"), D.passes(ratio, lp, ent).alias("passed"), D.is_silence(ns, lp).alias("silence"))


@query("silence_gate", "SELECT l.doc_id, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id) WHERE NOT ((l.doc_id % 10) / 9.0 > 0.6 AND -(l.doc_id % 17) / 10.0 < -1) AND trim(d.text) <> ''")
def silence_gate(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    quiet = D.is_silence((F.col("doc_id") % 10) / 9.0, -(F.col("doc_id") % 17) / 10.0)
    return j.where(~quiet & (F.trim("text") != "")).select("doc_id", "quality", "toxic")


BEAMS = ", w AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings), sc AS (SELECT lp.label, w.n // 15 AS tile, w.n % 15 // 5 AS step, CAST(w.n % 5 AS BIGINT) AS beam, id, v FROM lp JOIN w USING (vec_id))"


def _step(k, prev):
    return f""", t{k} AS (SELECT *, row_number() OVER (PARTITION BY label, tile, beam ORDER BY v DESC, id) AS r FROM sc WHERE step = {k}),
s{k} AS (SELECT label, tile, slot, total, beam, id FROM (SELECT t.label, t.tile, t.beam, t.id, b.total + t.v AS total, row_number() OVER (PARTITION BY t.label, t.tile ORDER BY b.total + t.v DESC, t.beam, t.id) AS slot FROM t{k} t JOIN {prev} b USING (label, tile, beam) WHERE r <= 5) WHERE slot <= 5),
b{k + 1} AS (SELECT label, tile, CAST(slot - 1 AS BIGINT) AS beam, total FROM s{k})"""


@query("beam_step", f"WITH {LOGP}{BEAMS}, b0 AS (SELECT DISTINCT label, tile, beam, 0.0::DOUBLE AS total FROM sc WHERE step = 0){_step(0, 'b0')}{_step(1, 'b1')}{_step(2, 'b2')} SELECT label, CAST(tile AS BIGINT) AS tile, CAST(slot AS INT) AS slot, beam, id, round(total, 6) AS total FROM s2")
def beam_step(spark, d):
    """Three steps over each fifteen embeddings of a label: scores of five beams at a time."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    w = table(spark, d, "embeddings").select("label", "vec_id", n.alias("n")).select("vec_id", F.expr("n div 15").cast("long").alias("tile"), F.expr("n % 15 div 5").alias("step"), (F.col("n") % 5).cast("long").alias("beam"))
    s = logp(spark, d).join(w, "vec_id").select("label", "tile", "step", "beam", "id", "v")
    beams = s.where("step = 0").select("label", "tile", "beam").distinct().withColumn("total", F.lit(0.0))
    for k in range(3):
        out = D.beam_step(beams, s.where(F.col("step") == k).drop("step"), ["label", "tile"], 5)
        beams = out.select("label", "tile", (F.col("slot") - 1).cast("long").alias("beam"), "total")
    return out.select("label", "tile", "slot", "beam", "id", R("total").alias("total"))


@query(
    "guided_command_score",
    f"""WITH {SCORES}, e AS (SELECT vec_id, id, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM scores), pr AS (SELECT vec_id, id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
voc AS (SELECT CAST(n AS BIGINT) AS id, substr('abcdefghijklmnopqrstuvwxyz', CAST(n % 26 + 1 AS BIGINT), CASE WHEN n < 26 THEN 1 ELSE 2 END) AS piece FROM (SELECT unnest(range(0, 48)) AS n)),
cmd AS (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS cmd FROM benchmark), pf AS (SELECT cmd, substr(cmd, 1, CAST(n AS BIGINT)) AS piece FROM (SELECT cmd, unnest(range(1, length(cmd) + 1)) AS n FROM cmd)),
s AS (SELECT vec_id, cmd, avg(p) AS s FROM pf JOIN voc USING (piece) JOIN pr USING (id) GROUP BY vec_id, cmd), z AS (SELECT vec_id, cmd, s / sum(s) OVER (PARTITION BY vec_id) AS s FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, cmd DESC) AS k FROM z) SELECT vec_id, cmd, round(s, 6) AS score FROM r WHERE k = 1""",
)
def guided_command_score(spark, d):
    """Commands scored by the mean probability of those of their prefixes that are one token, as shares of the row's total."""
    from pyspark.sql import Window

    p = D.softmax(scores(spark, d), ["vec_id"]).select("vec_id", "id", F.col("v").alias("p"))
    n = F.col("id")
    voc = spark.range(48).select("id", F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (n % 26 + 1).cast("int"), F.when(n < 26, 1).otherwise(2)).alias("piece"))
    cmd = table(spark, d, "benchmark").select(F.lower(F.split("text", " ")[0]).alias("cmd")).distinct()
    pf = cmd.select("cmd", F.explode(F.sequence(F.lit(1), F.length("cmd"))).alias("n")).select("cmd", F.expr("substring(cmd, 1, n)").alias("piece"))
    s = pf.join(F.broadcast(voc), "piece").join(p, "id").groupBy("vec_id", "cmd").agg(F.avg("p").alias("s"))
    s = s.withColumn("s", F.col("s") / F.sum("s").over(Window.partitionBy("vec_id")))
    return s.groupBy("vec_id").agg(F.max(F.struct(F.round("s", 9).alias("o"), "cmd", "s")).alias("b")).select("vec_id", "b.cmd", R("b.s").alias("score"))


@query("first_token", f"WITH {SCORES} SELECT vec_id, id, round(CASE WHEN id >= {TIMES} AND id <= 55 THEN v ELSE -9999.0 END, 6) AS v FROM scores")
def first_token(spark, d):
    """The first token has to be a time near the window's start, here one of eight."""
    return scores(spark, d).select("vec_id", "id", R(F.coalesce(D.first_token(F.col("id"), F.col("v"), TIMES, 55), F.lit(-9999.0))).alias("v"))


@query("suppress_blank", f"WITH {SCORES} SELECT vec_id, id, vec_id % 3 AS sampled, round(CASE WHEN id = 20 AND vec_id % 3 = 1 THEN -9999.0 ELSE v END, 6) AS v FROM scores")
def suppress_blank(spark, d):
    s = scores(spark, d).withColumn("sampled", F.col("vec_id") % 3)
    return s.select("vec_id", "id", "sampled", R(F.coalesce(D.suppress_blank(F.col("id"), F.col("v"), 20, F.col("sampled")), F.lit(-9999.0))).alias("v"))


@query("final_hypothesis", f"WITH {LOGP}, h AS (SELECT label, vec_id, vec_id % 7 AS length, round(sum(v), 0) AS total FROM lp GROUP BY label, vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total / (length + 1) DESC, vec_id DESC) AS k FROM h) SELECT label, vec_id, length, total + 0.0 AS total FROM r WHERE k = 1")
def final_hypothesis(spark, d):
    h = logp(spark, d).groupBy("label", "vec_id").agg(F.round(F.sum("v"), 0).alias("total")).withColumn("length", F.col("vec_id") % 7)
    return D.final_hypothesis(h, ["label"], "total", "length", "vec_id").select("label", "vec_id", "length", (F.col("total") + 0.0).alias("total"))


@query("unconditioned_retry", "WITH e AS (SELECT user_id, event_type IN ('error', 'click') AS conditioned, CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS text FROM events), w AS (SELECT user_id, conditioned, max(text) AS longest, count(*) AS n FROM e GROUP BY user_id, conditioned), c AS (SELECT user_id, bool_or(conditioned AND longest <> '') AS fine, bool_or(NOT conditioned) AS other FROM w GROUP BY user_id) SELECT user_id, conditioned, w.n FROM w JOIN c USING (user_id) WHERE conditioned = (fine OR NOT other)")
def unconditioned_retry(spark, d):
    """Users as windows, their errors and clicks (without text) as decoded with the context, the rest as decoded without."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").isin("error", "click").alias("conditioned"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("text"))
    return D.unconditioned(e, ["user_id"], "conditioned", "text").groupBy("user_id", "conditioned").agg(F.count("*").alias("n"))


@query("stage_timings", "WITH s AS (SELECT event_type AS stage, CAST(count(*) AS BIGINT) AS calls, sum(value) AS total, max(value) AS longest FROM events GROUP BY event_type) SELECT stage, calls, round(total, 4) AS total, round(longest, 6) AS longest, round(total / calls, 6) AS mean, round(total / sum(total) OVER (), 9) AS share FROM s")
def stage_timings(spark, d):
    """Event types as stages and their values as seconds."""
    t = D.stage_timings(table(spark, d, "events"), "event_type", "value")
    return t.select(F.col("event_type").alias("stage"), "calls", F.round("total", 4).alias("total"), R("longest").alias("longest"), R("mean").alias("mean"), F.round("share", 9).alias("share"))


@query("progress", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events), p AS (SELECT user_id, done, CAST(least(100, done * 100 // n) AS INT) AS percent FROM s JOIN n USING (user_id)) SELECT user_id, CAST(percent AS BIGINT) // 10 * 10 AS percent, min(done) AS done FROM p GROUP BY user_id, CAST(percent AS BIGINT) // 10 * 10")
def progress(spark, d):
    """When each tenth of a user's events was done."""
    s = tokens(spark, d).select("user_id", (F.col("i") + 1).alias("done"))
    n = s.groupBy("user_id").agg(F.max("done").alias("n"))
    return D.progress(s.join(n, "user_id"), ["user_id"], "done", "n", 10)


@query(
    "vocab_specials",
    "SELECT event_id, id, id > 50257 AND id < 50364 AS special, id >= 50364 AS is_time, CASE WHEN id >= 50364 THEN round((id - 50364) * 0.02::DOUBLE, 2) ELSE -1 END AS seconds FROM (SELECT event_id, 50200 + event_id * 37 % 1664 AS id FROM events)",
)
def vocab_specials(spark, d):
    """Events as tokens from the end of a multilingual vocabulary: control tokens, times, and the seconds these stand for."""
    i = F.col("id")
    t = table(spark, d, "events").select("event_id", (50200 + F.col("event_id") * 37 % 1664).alias("id"))
    return t.select("event_id", "id", ((i > 50257) & (i < 50364)).alias("special"), (i >= 50364).alias("is_time"), F.when(i >= 50364, F.round((i - 50364) * 0.02, 2)).otherwise(-1.0).alias("seconds"))


@query(
    "temperature_ladder",
    """WITH p AS (SELECT l_discount AS start, l_tax * 4 AS step, count(*) AS lines FROM lineitem GROUP BY ALL),
n AS (SELECT *, CASE WHEN step > 0 THEN greatest(floor((1.000001::DOUBLE - start) / step + 1e-9::DOUBLE), 0) ELSE 0 END AS n FROM p), r AS (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) AS i FROM n)
SELECT round(start, 6) AS start, round(step, 6) AS step, lines, CAST(i AS INT) AS rung, round(CASE WHEN step > 0 THEN least(1.0::DOUBLE, start + i * step) ELSE start END, 6) AS t FROM r""",
)
def temperature_ladder(spark, d):
    """The ladders that lines' discounts as first temperatures and taxes as steps would give; no tax gives one rung."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_discount").alias("start"), (F.col("l_tax") * 4).alias("step")).agg(F.count("*").alias("lines"))
    return p.select("start", "step", "lines", F.posexplode(ladder(F.col("start"), F.col("step"))).alias("rung", "t")).select(R("start").alias("start"), R("step").alias("step"), "lines", "rung", R("t").alias("t"))


_LANGS = ", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(zip(lookups.LANGUAGE_CODES, lookups.LANGUAGE_NAMES, strict=True)))


@query("language_lookup", f"WITH l(id, code, name) AS (VALUES {_LANGS}) SELECT lang, CAST(id AS INT) AS id, name, count(*) AS n FROM documents JOIN l ON code = lang GROUP BY ALL")
def language_lookup(spark, d):
    j = table(spark, d, "documents").join(F.broadcast(lookups.languages(spark)), F.col("code") == F.col("lang"))
    return j.groupBy("lang", "id", "name").agg(F.count("*").alias("n"))


_HEADS = ", ".join(f"('{p}', {x.replace(':', ', ')})" for p, h in lookups.ALIGNMENT_HEADS.items() for x in h.split())


_PRESETS = ", ".join(f"'{p}'" for p in lookups.ALIGNMENT_HEADS)


@query(
    "alignment_heads",
    f"WITH h(preset, layer, head) AS (VALUES {_HEADS}), p AS (SELECT p_partkey, [{_PRESETS}][p_partkey % 12 + 1] AS preset FROM part) SELECT p_partkey, preset, count(*) AS n, CAST(count(DISTINCT layer) AS BIGINT) AS layers, CAST(sum(layer * 100 + head) AS BIGINT) AS checksum FROM p JOIN h USING (preset) GROUP BY p_partkey, preset",
)
def alignment_heads(spark, d):
    """Parts as models of twelve presets, and the heads that each model aligns by."""
    presets = F.array(*map(F.lit, lookups.ALIGNMENT_HEADS))
    p = table(spark, d, "part").select("p_partkey", F.element_at(presets, (F.col("p_partkey") % 12 + 1).cast("int")).alias("preset"))
    h = p.join(F.broadcast(lookups.alignment_heads(spark)), "preset")  # a fixed list of some hundred heads
    return h.groupBy("p_partkey", "preset").agg(F.count("*").alias("n"), F.countDistinct("layer").alias("layers"), F.sum(F.col("layer") * 100 + F.col("head")).alias("checksum"))


#: Beam search: beams, ids a hypothesis can hold, steps at most; score rows that each window of a label's rows has.
WIDTH, CONTEXT, MOST, TILE = 4, 6, 9, 15
_SEARCHED = """w AS (SELECT label, vec_id, n // 15 AS tile, n % 15 AS place, count(*) OVER (PARTITION BY label, n // 15) AS size FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings)),
likely AS (SELECT label, tile, place, id, v, r FROM (SELECT w.label, tile, place, id, round(v + CASE WHEN id = 40 THEN 2 ELSE 0 END, 2) AS v, row_number() OVER (PARTITION BY vec_id ORDER BY round(v + CASE WHEN id = 40 THEN 2 ELSE 0 END, 2) DESC, id) AS r FROM lp JOIN w USING (vec_id)) WHERE r <= 4),
z AS (SELECT DISTINCT label, tile, size, 0 AS step, CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS beam, CAST([] AS BIGINT[]) AS ids, CAST(0 AS BIGINT) AS last, 0.0::DOUBLE AS total, CAST(0 AS BIGINT) AS done, false AS ends FROM w
UNION ALL SELECT label, tile, size, step, slot, row_number() OVER (PARTITION BY label, tile, ends ORDER BY slot) - 1, CASE WHEN ends THEN ids ELSE list_append(ids, id) END, id, CASE WHEN id <> 40 AND ends THEN before ELSE total END, CAST(done + sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY label, tile) AS BIGINT), ends
FROM (SELECT *, id = 40 OR len(ids) >= 6 AS ends FROM (SELECT z.label, z.tile, size, step + 1 AS step, ids, id, z.total AS before, z.total + greatest(v, -30) AS total, done, row_number() OVER (PARTITION BY z.label, z.tile ORDER BY z.total + greatest(v, -30) DESC, beam, r) AS slot
FROM z JOIN likely l ON z.label = l.label AND z.tile = l.tile AND l.place = (z.step * 4 + z.beam + z.last) % size WHERE NOT ends AND done < 4 AND step < 9) WHERE slot <= 4)),
f AS (SELECT *, total / (len(ids) + 1) AS mean FROM z WHERE step > 0 AND (ends OR (step = 9 AND done < 4))),
g AS (SELECT *, row_number() OVER (PARTITION BY label, tile ORDER BY mean DESC, step DESC, ends, slot DESC) AS k, sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY label, tile) AS ended, max(step) OVER (PARTITION BY label, tile) AS steps FROM f)"""


@query(
    "beam_search",
    f"WITH RECURSIVE {LOGP}, {_SEARCHED} SELECT label, CAST(tile AS BIGINT) AS tile, array_to_string(ids, ' ') AS ids, round(total, 6) AS total, round(mean, 6) AS mean, CAST(ended AS BIGINT) AS ended, CAST(steps AS INT) AS steps FROM g WHERE k = 1",
)
def beam_search(spark, d):
    """A search for each fifteen embeddings of a label: step, beam and last id say whose scores come next. Rounded scores make ties."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    w = table(spark, d, "embeddings").select("label", "vec_id", n.alias("n")).select("label", "vec_id", F.expr(f"n div {TILE}").cast("long").alias("tile"), (F.col("n") % TILE).cast("long").alias("place"))
    w = w.withColumn("size", F.count("*").over(Window.partitionBy("label", "tile")))
    v = F.round(F.col("v") + F.when(F.col("id") == END, 2).otherwise(0), 2)
    rows = logp(spark, d).drop("label").join(w, "vec_id").select("label", "tile", "place", "size", "id", v.alias("v"))
    path = f"{scratch(spark, 'scores')}/rows"
    rows.write.parquet(path)  # read at each step
    rows = spark.read.schema(rows.schema).parquet(path)
    sizes = w.select("label", "tile", "size").distinct()

    def scores_of(live):
        place = (F.col("step") * 4 + F.col("beam") + F.coalesce(F.col("last"), F.lit(0))) % F.col("size")
        return live.join(sizes, ["label", "tile"]).select("label", "tile", "beam", place.cast("long").alias("place")).join(rows.drop("size"), ["label", "tile", "place"]).select("label", "tile", "beam", "id", "v")

    out = search.beam_search(w, scores_of, ["label", "tile"], width=WIDTH, end=END, context=CONTEXT, most=MOST)
    return out.select("label", "tile", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), R("total").alias("total"), R("mean").alias("mean"), "ended", "steps")


def _repeated_less(past, matrix):
    """A hook: what was said already scores less, positive scores by a division and negative ones by a product."""
    import numpy as np

    row = np.repeat(np.arange(len(past)), [len(p) for p in past])
    column = np.concatenate([np.zeros(0, int), *past]).astype(int)
    seen = np.zeros(matrix.shape, bool)
    seen[row, column] = True
    return np.where(seen, np.where(matrix > 0, matrix / 1.5, matrix * 1.5), matrix)


@query(
    "hooked_step",
    f"""WITH {SCORES}, p AS (SELECT vec_id, [vec_id % 48, (vec_id * 7) % 48, vec_id % 5] AS past FROM embeddings),
h AS (SELECT vec_id, id, CASE WHEN list_contains(past, id) THEN CASE WHEN v > 0 THEN v / 1.5 ELSE v * 1.5 END ELSE v END AS v FROM scores JOIN p USING (vec_id) WHERE id < 48 AND id <> 40),
b AS (SELECT vec_id, max(v) AS m FROM h GROUP BY vec_id) SELECT vec_id, max(CASE WHEN v = m THEN id END) AS id, round(max(m) - max(m) - ln(sum(exp(v - m))), 6) AS logprob FROM h JOIN b USING (vec_id) GROUP BY vec_id""",
)
def hooked_step(spark, d):
    """A greedy step: times and the end token masked, a user's function over (ids so far, scores), then the last best and its log-probability."""
    n = F.col("vec_id")
    past = F.array((n % 48).cast("long"), (n * 7 % 48).cast("long"), (n % 5).cast("long"))
    v = table(spark, d, "embeddings").select("vec_id", past.alias("past"), F.transform("embedding", lambda x, i: F.when((i < TIMES) & (i != END), x.cast("double") * 10)).alias("v"))
    h = search.filter_scores(v, "past", "v", _repeated_less)
    top = F.array_max("v")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(F.exp(x - top), F.lit(0.0)))
    return h.select("vec_id", search.argmax_last(F.col("v")).alias("id"), R(-F.ln(total)).alias("logprob"))
