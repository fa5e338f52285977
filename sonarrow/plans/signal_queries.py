"""Signals: samples, windows, spectra, energies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import signal as G
from ..operators import spectra
from ..tables import table
from .catalog import query
from .views import SIGNAL, TENSOR, signal, tensor, vectors

R = lambda c: F.round(c, 6)


@query("pcm_quantize_i16", f"WITH {TENSOR} SELECT vec_id, CAST(pos AS BIGINT) AS pos, CAST(trunc(greatest(-1.0, least(1.0, v * 3)) * 32767) AS INT) AS q, round(trunc(greatest(-1.0, least(1.0, v * 3)) * 32767) / 32768.0, 6) AS back FROM tensor")
def pcm_quantize_i16(spark, d):
    q = S.float_to_i16(F.col("v") * 3)
    return tensor(spark, d).select("vec_id", F.col("pos").cast("long").alias("pos"), q.alias("q"), R(S.i16_to_float(q)).alias("back"))


@query("stereo_downmix", "SELECT user_id, frame, round(avg(value), 6) AS x, count(*) AS channels FROM (SELECT user_id, event_id // 2 AS frame, value FROM events) GROUP BY user_id, frame")
def stereo_downmix(spark, d):
    e = table(spark, d, "events").select("user_id", F.expr("event_id div 2").alias("frame"), "value")
    n = e.groupBy("user_id", "frame").agg(F.count("*").alias("channels"))
    return G.downmix(e, ["user_id"], "frame", "value").join(n, ["user_id", "frame"]).select("user_id", "frame", R("x").alias("x"), "channels")


@query(
    "resample_linear",
    f"""WITH {SIGNAL}, n AS (SELECT user_id, count(*) AS n FROM signal GROUP BY user_id),
o AS (SELECT user_id, n, unnest(range(0, CAST(round(n * 2 / 3.0) AS BIGINT))) AS i FROM n),
p AS (SELECT *, least(CAST(floor(i * 3 / 2.0) AS BIGINT), n - 1) AS a, least(CAST(floor(i * 3 / 2.0) AS BIGINT) + 1, n - 1) AS b, i * 3 / 2.0 - floor(i * 3 / 2.0) AS f FROM o)
SELECT p.user_id, p.i, round(s.x + (t.x - s.x) * f, 6) AS x FROM p JOIN signal s ON s.user_id = p.user_id AND s.i = a JOIN signal t ON t.user_id = p.user_id AND t.i = b""",
)
def resample_linear(spark, d):
    return G.resample_linear(signal(spark, d), ["user_id"], 3, 2).select("user_id", "i", R("x").alias("x"))


@query("pad_or_trim", "SELECT vec_id, CAST(80 AS INT) AS n80, CAST(48 AS INT) AS n48, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS s80, round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 6) AS s48 FROM embeddings")
def pad_or_trim(spark, d):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    a, b = G.pad_or_trim(F.col("x"), 80), G.pad_or_trim(F.col("x"), 48)
    return vectors(spark, d).select("vec_id", F.size(a).alias("n80"), F.size(b).alias("n48"), R(total(a)).alias("s80"), R(total(b)).alias("s48"))


@query(
    "reflect_pad",
    f"WITH {TENSOR}, o AS (SELECT vec_id, unnest(range(-3, 67)) AS j FROM embeddings), m AS (SELECT vec_id, j + 3 AS j, CASE WHEN j < 0 THEN -j WHEN j > 63 THEN 126 - j ELSE j END AS pos FROM o) "
    "SELECT vec_id, CAST(j AS BIGINT) AS j, round(v, 6) AS v FROM m JOIN tensor USING (vec_id, pos)",
)
def reflect_pad(spark, d):
    p = vectors(spark, d).select("vec_id", F.posexplode(G.reflect_pad(F.col("x"), 3)).alias("j", "v"))
    return p.select("vec_id", F.col("j").cast("long").alias("j"), R("v").alias("v"))


@query(
    "frame_overlap",
    f"WITH {TENSOR}, t AS (SELECT unnest(range(0, 8)) AS t) SELECT vec_id, t.t, count(*) AS n, round(sum(v * 0.5 * (1 - cos(2 * pi() * (pos - t.t * 8) / 16))), 6) AS s FROM tensor JOIN t ON pos >= t.t * 8 AND pos < t.t * 8 + 16 GROUP BY vec_id, t.t",
)
def frame_overlap(spark, d):
    f = G.frames(tensor(spark, d).select("vec_id", F.col("pos").cast("long").alias("i"), F.col("v").alias("x")), ["vec_id"], 16, 8)
    return G.windowed(f, 16).groupBy("vec_id", "t").agg(F.count("*").alias("n"), R(F.sum("x")).alias("s"))


DFT = f"{TENSOR}, ks AS (SELECT unnest(range(0, 33)) AS k), dft AS (SELECT vec_id, label, k, pow(sum(v * cos(2 * pi() * k * pos / 64)), 2) + pow(sum(v * sin(2 * pi() * k * pos / 64)), 2) AS p FROM tensor, ks GROUP BY vec_id, label, k)"


def _power(spark, d):
    return vectors(spark, d).select("vec_id", "label", F.posexplode(spectra.fft_power("x")).alias("k", "p")).withColumn("k", F.col("k").cast("long"))


@query("dft_power", f"WITH {DFT} SELECT vec_id, CAST(k AS BIGINT) AS k, round(p, 6) AS p FROM dft")
def dft_power(spark, d):
    return _power(spark, d).select("vec_id", "k", R("p").alias("p"))


_MEL = lambda hz: f"CASE WHEN {hz} < 1000 THEN {hz} * 3 / 200.0 ELSE 15 + ln({hz} / 1000.0) / (ln(6.4) / 27) END"
_HZ = lambda m: f"CASE WHEN {m} < 15 THEN {m} * 200 / 3.0 ELSE 1000 * exp(ln(6.4) / 27 * ({m} - 15)) END"


def _bank(n_mels, n_fft, rate):
    top = f"({_MEL(f'{rate / 2}::DOUBLE')})"
    e = lambda j: f"({_HZ(f'({top} * (m + {j}) / {n_mels + 1})')})"
    return f"""edges AS (SELECT m, {e(0)} AS lo, {e(1)} AS mid, {e(2)} AS hi FROM (SELECT unnest(range(0, {n_mels})) AS m)),
bank AS (SELECT m, k, greatest(0.0, least((k * {rate / n_fft}::DOUBLE - lo) / (mid - lo), (hi - k * {rate / n_fft}::DOUBLE) / (hi - mid))) * 2 / (hi - lo) AS w FROM edges, (SELECT unnest(range(0, {n_fft // 2 + 1})) AS k))"""


@query("mel_filterbank", f"WITH {DFT}, {_bank(8, 64, 16000)} SELECT vec_id, CAST(m AS BIGINT) AS m, round(sum(w * p), 6) AS e, round(sum(w) * 1000, 6) AS area FROM dft JOIN bank USING (k) WHERE w > 0 GROUP BY vec_id, m")
def mel_filterbank(spark, d):
    """The energies of eight mel bands of each embedding as a frame, and the weight that each band has."""
    bank = G.mel_filterbank(spark, 8, 64, 16000).where("w > 0").withColumn("k", F.col("k").cast("long"))
    p = _power(spark, d).join(F.broadcast(bank), "k")  # 8 by 33 weights
    return p.groupBy("vec_id", "m").agg(R(F.sum(F.col("w") * F.col("p"))).alias("e"), R(F.sum("w") * 1000).alias("area"))


@query(
    "log_mel",
    f"""WITH {DFT}, {_bank(8, 64, 16000)}, e AS (SELECT vec_id, label, m, log10(greatest(sum(w * p), 1e-10)) AS l FROM dft JOIN bank USING (k) WHERE w > 0 GROUP BY vec_id, label, m)
SELECT vec_id, CAST(m AS BIGINT) AS m, round((greatest(l, max(l) OVER (PARTITION BY label) - 8) + 4) / 4, 6) AS v FROM e""",
)
def log_mel(spark, d):
    bank = G.mel_filterbank(spark, 8, 64, 16000).withColumn("k", F.col("k").cast("long"))
    return G.log_mel(_power(spark, d), bank, ["vec_id", "label"], ["label"]).select("vec_id", "m", R("v").alias("v"))


@query("highpass_closed_form", f"WITH {SIGNAL} SELECT user_id, i, round(CASE WHEN i = 0 THEN x ELSE x * (1 / 16000.0) / (1 / (2 * pi() * 100) + 1 / 16000.0) END, 6) AS y FROM signal")
def highpass_closed_form(spark, d):
    return signal(spark, d).select("user_id", "i", R(G.high_pass_at(F.col("i"), F.col("x"), 100, 16000)).alias("y"))


@query(
    "vad_energy_tail",
    f"""WITH {SIGNAL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM signal),
a AS (SELECT user_id, count(*) AS n, avg(abs(x)) AS e, avg(abs(x)) FILTER (k <= 10) AS t FROM r GROUP BY user_id) SELECT user_id, n, round(e, 6) AS all_energy, round(t, 6) AS tail_energy, n > 10 AND t <= 0.9 * e AS quiet FROM a""",
)
def vad_energy_tail(spark, d):
    q = G.quiet_tail(signal(spark, d), ["user_id"], 10, 0.9)
    return q.select("user_id", "n", R("all_energy").alias("all_energy"), R("tail_energy").alias("tail_energy"), "quiet")


@query(
    "diarize_rms",
    f"""WITH {SIGNAL}, f AS (SELECT user_id, i // 2 AS i, x AS left_, lead(x) OVER (PARTITION BY user_id ORDER BY i) AS right_, i AS o FROM signal), st AS (SELECT * FROM f WHERE o % 2 = 0 AND right_ IS NOT NULL),
g AS (SELECT user_id, s AS seg, s * 7 AS a, CASE WHEN s = 2 THEN s * 7 ELSE s * 7 + 5 END AS b FROM (SELECT user_id, unnest(range(0, (count(*) // 2) // 7 + 1)) AS s FROM signal GROUP BY user_id)),
e AS (SELECT g.user_id, g.seg, sqrt(avg(left_ * left_)) AS l, sqrt(avg(right_ * right_)) AS r FROM g JOIN st ON st.user_id = g.user_id AND st.i >= a AND st.i < b GROUP BY g.user_id, g.seg)
SELECT g.user_id, g.seg, g.a, g.b, CASE WHEN l IS NULL THEN -1 WHEN r > l THEN 1 ELSE 0 END AS speaker FROM g LEFT JOIN e USING (user_id, seg)""",
)
def diarize_rms(spark, d):
    s = signal(spark, d)
    stereo = s.groupBy("user_id", F.expr("i div 2").alias("f")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("x"))).alias("left"), F.max(F.when(F.col("i") % 2 == 1, F.col("x"))).alias("right"))
    stereo = stereo.where("right is not null").withColumnRenamed("f", "i")
    # spans over the whole of each user, the last of which may lie beyond the end
    spans = s.groupBy("user_id").agg(F.expr("count(*) div 2 div 7").alias("n")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("seg"))
    spans = spans.withColumn("a", F.col("seg") * 7).withColumn("b", F.when(F.col("seg") == 2, F.col("seg") * 7).otherwise(F.col("seg") * 7 + 5))
    return G.louder_channel(stereo, spans, ["user_id"], 16).withColumn("speaker", F.coalesce("speaker", F.lit(-1)))


@query("crop_window", f"WITH {SIGNAL} SELECT user_id, i - 5 AS i, x FROM signal WHERE i >= 5 AND i < 25")
def crop_window(spark, d):
    return G.crop(signal(spark, d), 5, 20).select("user_id", (F.col("i") - 5).alias("i"), "x")


@query(
    "f16_codec",
    f"""WITH {TENSOR}, x AS (SELECT vec_id, pos, v * CASE pos % 4 WHEN 0 THEN 1 WHEN 1 THEN 1e6 WHEN 2 THEN 1e-5 ELSE 300 END::DOUBLE AS x FROM tensor), e AS (SELECT *, greatest(-14, CAST(floor(log2(greatest(abs(x), pow(2::DOUBLE, -30)))) AS INT)) AS e FROM x),
f AS (SELECT *, CAST(round_even(abs(x) / pow(2::DOUBLE, e - 10), 0) AS BIGINT) AS f FROM e), b AS (SELECT *, CASE WHEN x < 0 THEN 32768 ELSE 0 END + CASE WHEN abs(x) >= 65520 THEN 31744 WHEN f >= 1024 THEN (e + 15) * 1024 + f - 1024 ELSE f END AS bits FROM f),
c AS (SELECT *, (bits >> 10) & 31 AS ex, bits & 1023 AS fr FROM b)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, CAST(bits AS INT) AS bits, CASE WHEN ex < 31 THEN round(CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0 END * CASE WHEN ex = 0 THEN fr / 1024.0::DOUBLE * pow(2::DOUBLE, -14) ELSE (1 + fr / 1024.0::DOUBLE) * pow(2::DOUBLE, ex - 15) END * 1048576, 3) + 0.0 END AS scaled FROM c""",
)
def f16_codec(spark, d):
    """Values of four sizes, from far below the normal ones to beyond the largest, as half-precision bits and back."""
    k = F.col("pos") % 4
    x = F.col("v") * F.when(k == 0, 1.0).when(k == 1, 1e6).when(k == 2, 1e-5).otherwise(300.0)
    h = tensor(spark, d).select("vec_id", F.col("pos").cast("long").alias("pos"), S.float_to_half(x).alias("bits"))
    back = S.half_to_float(F.col("bits"))
    return h.select("vec_id", "pos", "bits", F.when(F.abs(back) != float("inf"), F.round(back * 1048576, 3) + 0.0).alias("scaled"))


@query(
    "log_mel_signal",
    f"""WITH {SIGNAL}, n AS (SELECT user_id, count(*) AS n FROM signal GROUP BY user_id), {_bank(6, 20, 16000)},
t AS (SELECT user_id, n, unnest(range(0, n // 8)) AS t FROM n), j AS (SELECT user_id, n, t, k AS o, t * 8 + k - 10 AS j FROM t, (SELECT unnest(range(0, 20)) AS k)),
g AS (SELECT user_id, t, o, CASE WHEN j < 0 THEN -j WHEN j >= n THEN 2 * (n - 1) - j ELSE j END AS i, n FROM j), h AS (SELECT user_id, t, o, CASE WHEN i < 0 OR i > n - 1 THEN n - 1 ELSE i END AS i FROM g),
f AS (SELECT h.user_id, t, o, x * (0.5 - 0.5 * cos(2 * pi() * o / 20)) AS x FROM h JOIN signal s ON s.user_id = h.user_id AND s.i = h.i),
p AS (SELECT user_id, t, k, pow(sum(x * cos(2 * pi() * k * o / 20)), 2) + pow(sum(x * sin(2 * pi() * k * o / 20)), 2) AS p FROM f, (SELECT unnest(range(0, 11)) AS k) GROUP BY user_id, t, k),
e AS (SELECT user_id, t, m, log10(greatest(sum(w * p), 1e-10)) AS l FROM p JOIN bank USING (k) GROUP BY user_id, t, m)
SELECT user_id, CAST(t AS BIGINT) AS t, CAST(m AS BIGINT) AS m, round((greatest(l, max(l) OVER (PARTITION BY user_id) - 8) + 4) / 4, 6) AS v FROM e""",
)
def log_mel_signal(spark, d):
    """The whole chain over each user's values as a signal: mirrored ends, frames, window, power, mel bands, logarithm, clamp."""
    mel = spectra.log_mel(signal(spark, d), ["user_id"], n_fft=20, hop=8, n_mels=6, rate=16000, block=3)
    return mel.select("user_id", "t", F.posexplode("mel").alias("m", "v")).select("user_id", "t", F.col("m").cast("long").alias("m"), R("v").alias("v"))
