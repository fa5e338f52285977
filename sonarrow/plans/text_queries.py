"""Text, JSON and request queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import text as X
from ..scratch import scratch
from ..streaming import chat, sinks
from ..streaming.stateful import state_store
from ..tables import table
from .catalog import query

R = lambda c: F.round(c, 6)
#: What items are held against.
PROMPTS = ["that and one", "re the on", "here we go", "i"]
_PROMPTS = ", ".join(f"({k}, '{p}')" for k, p in enumerate(PROMPTS))
# prompts are ASCII, so any other character is as far from them as the tilde that stands for it, in bytes and in characters
PAIRS = f"p AS (SELECT item_id AS a, k AS b, prompt AS ta, lower(array_to_string(string_split(regexp_replace(text, '[^\\x00-\\x7f]', '~', 'g'), ' ')[1:4], ' ')) AS tb FROM benchmark, (VALUES {_PROMPTS}) v(k, prompt))"
SIM = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"


def pairs(spark, d):
    """The first four words of every item beside every prompt."""
    prompts = F.array(*[F.struct(F.lit(k).alias("b"), F.lit(p).alias("ta")) for k, p in enumerate(PROMPTS)])
    return table(spark, d, "benchmark").select(F.col("item_id").alias("a"), F.lower(X.first_words(F.col("text"), 4)).alias("tb"), F.inline(prompts))


@query("fuzzy_wake_match", f"WITH {PAIRS}, s AS (SELECT a, b, {SIM.format('ta', 'tb')} AS s, ta, tb FROM p) SELECT a, b, round(s, 6) AS s, s > 0.7 AS accepted, s >= 0.8 AND length(tb) / length(ta)::DOUBLE BETWEEN 0.8 AND 1.2 AS activated FROM s")
def fuzzy_wake_match(spark, d):
    s = pairs(spark, d).withColumn("s", X.similarity(F.col("ta"), F.col("tb")))
    return s.select("a", "b", R("s").alias("s"), X.accepts(F.col("s")).alias("accepted"), X.activates(F.col("s"), F.col("tb"), F.col("ta")).alias("activated"))


@query(
    "prompt_cut",
    f"""WITH {PAIRS}, c AS (SELECT a, b, ta, tb, unnest(range(CAST(floor(length(ta) * 0.8) AS BIGINT), CAST(least(ceil(length(ta) * 1.2), length(tb)) AS BIGINT) + 1)) AS cut FROM p),
s AS (SELECT a, b, cut, {SIM.format('substr(tb, 1, cut)', 'ta')} AS s FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, cut) AS k FROM s) SELECT a, b, cut, round(s, 6) AS score FROM r WHERE k = 1""",
)
def prompt_cut(spark, d):
    return X.best_cut(pairs(spark, d), ["a", "b"], "tb", "ta").select("a", "b", F.col("cut").cast("long").alias("cut"), R("score").alias("score"))


@query("prompt_split", "SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS prompt, array_to_string(string_split(text, ' ')[4:], ' ') AS command FROM benchmark")
def prompt_split(spark, d):
    p, c = X.split_prompt(F.col("text"), F.lit("one two three"))
    return table(spark, d, "benchmark").select("item_id", p.alias("prompt"), c.alias("command"))


# without a look ahead: white space goes one character at a time, which leaves runs of letters and digits as they are
_COUNTS = r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '''(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\x0B\f\rA-Za-z0-9]+|[ \t\n\x0B\f\r]') AS p FROM documents)
SELECT doc_id, CAST(len(list_filter(p, lambda x: regexp_full_match(x, ' ?[A-Za-z]+'))) AS BIGINT) AS letters, CAST(len(list_filter(p, lambda x: regexp_full_match(x, ' ?[0-9]+'))) AS BIGINT) AS digits FROM t"""


@query("pretokenize_counts", _COUNTS)
def pretokenize_counts(spark, d):
    return letters_and_digits(table(spark, d, "documents"), "text")


@query("pretokenize_counts_full", _COUNTS)
def pretokenize_counts_full(spark, d):
    """The name that the whole job had while pretokenize_counts read prefixes."""
    return pretokenize_counts(spark, d)


def letters_and_digits(t, text):
    """Runs of letters and of digits among the pre-tokens of each document's text."""
    count = lambda p: F.size(F.filter("p", lambda x: x.rlike(p))).cast("long")
    return t.select("doc_id", X.pretokens(F.col(text)).alias("p")).select("doc_id", count("^ ?[A-Za-z]+$").alias("letters"), count("^ ?[0-9]+$").alias("digits"))


@query("greedy_encode")
def greedy_encode(spark, d):
    vocab = {bytes([i]): i for i in range(256)} | {w.encode(): 256 + i for i, w in enumerate(("he", "llo", "hello", " the", "the", " of", " and", "en", "er", "ch"))}
    ids = X.greedy_encoder(vocab)
    t = table(spark, d, "documents").withColumn("ids", ids("text"))
    return t.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: (s * 31 + x) % 1000003).alias("checksum"))


@query("greedy_round_trip", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations")
def greedy_round_trip(spark, d):
    """Texts encoded by longest match and decoded by a join with the vocabulary are themselves; one without ids is empty."""
    words = [bytes([i]) for i in range(256)] + [b"th", b"the", b" the", b"ing"]
    ids = X.greedy_encoder({w: i for i, w in enumerate(words)})
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    e = t.select("conv_id", "turn", F.posexplode(ids("text")).alias("k", "id"))
    vocab = spark.createDataFrame([(i, bytearray(w)) for i, w in enumerate(words)], "id int, bytes binary")
    back = X.decode(e, ["conv_id", "turn"], F.broadcast(vocab))
    return t.select("conv_id", "turn").join(back, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@query("compression_ratio")
def compression_ratio(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R(X.compressibility("text")).alias("ratio"))


@query(
    "grammar_expand",
    """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), x AS (SELECT item_id, [coalesce(w[1], 'hello'), coalesce(w[2], 'hi')] AS g, [coalesce(w[3], 'ann'), coalesce(w[4], 'bob'), coalesce(w[5], 'cy')] AS n FROM w),
g AS (SELECT item_id, unnest(g) AS g, n FROM x), gn AS (SELECT item_id, g, unnest(n) AS n FROM g) SELECT item_id, text FROM (SELECT DISTINCT item_id, 'say: ' || g || ' "' || n || '"' AS text FROM gn UNION ALL SELECT item_id, 'bye' FROM x)""",
)
def grammar_expand(spark, d):
    """Each item's first words as the terminals of a grammar of its own, and all strings that it has."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    word = lambda k, other: F.concat(F.lit('"'), F.coalesce(F.get(w, F.lit(k)), F.lit(other)), F.lit('"'))
    rules = F.concat(
        F.lit('root ::= "say: " (greeting) " " "\\"" name "\\"" | "bye" # the end\ngreeting ::= '), word(0, "hello"), F.lit(" | "), word(1, "hi"),
        F.lit("\n\nname ::= "), word(2, "ann"), F.lit(" | "), word(3, "bob"), F.lit("\nname ::= "), word(4, "cy"),
    )
    return table(spark, d, "benchmark").select("item_id", F.explode(X.grammar_strings(rules)).alias("text"))


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || json_extract_string(props, '$.k') AS tag FROM events")
def json_path(spark, d):
    e = table(spark, d, "events").withColumn("v", F.parse_json("props"))
    return e.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"), F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("tag"))


@query("chat_body", """SELECT conv_id, CAST(count(*) AS BIGINT) AS n, '{"model":"m","messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']' || CASE WHEN conv_id % 2 = 0 THEN ',"temperature":0.5' ELSE '' END || '}' AS body FROM conversations GROUP BY conv_id""")
def chat_body(spark, d):
    c = table(spark, d, "conversations")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    g = c.groupBy("conv_id").agg(m.alias("m"), F.count("*").alias("n"))
    return g.select("conv_id", "n", X.chat_body(F.lit("m"), F.col("m"), temperature=F.when(F.col("conv_id") % 2 == 0, 0.5)).alias("body"))


@query("chat_reply", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'raw' ELSE role END AS reply FROM conversations")
def chat_reply(spark, d):
    role = F.to_json(F.struct(F.col("role").alias("r")))
    inner = F.get_json_object(role, "$.r")
    ok = F.concat(F.lit('{"choices":[{"message":{"content":"'), inner, F.lit('"}}]}'))
    err = F.concat(F.lit('{"error":{"message":"'), inner, F.lit('"}}'))
    body = F.when(F.col("turn") % 3 == 0, ok).when(F.col("turn") % 3 == 1, err).otherwise("raw")
    return table(spark, d, "conversations").select("conv_id", "turn", X.chat_reply(body).alias("reply"))


@query("session_messages", "SELECT conv_id, turn, role, text AS content FROM conversations")
def session_messages(spark, d):
    """A session saved as one JSON array for each conversation and loaded again."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    saved = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(m).alias("json"))
    return saved.select("conv_id", F.inline(F.from_json("json", "array<struct<turn:bigint,role:string,content:string>>")))


@query("persona_render", "SELECT conv_id, turn, role || ' of ' || conv_id || ' says ' || text AS line FROM conversations")
def persona_render(spark, d):
    line = X.persona(F.lit("{0} of {1} says {2}"), F.col("role"), F.col("conv_id").cast("string"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))


@query(
    "form_options",
    """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-' ELSE 'de' END AS language, event_id % 2 = 0 AS translate, false AS tinydiarize, event_id % 2 = 1 AS suppress_non_speech, false AS carry_initial_prompt,
CASE WHEN event_id % 4 = 0 THEN '-' ELSE 'p' || k END AS initial_prompt, k * 2 AS max_context, CAST(0 AS BIGINT) AS max_len, CAST(CASE WHEN event_id % 5 = 0 THEN 5 ELSE k END AS BIGINT) AS beam_size, CAST(CASE WHEN event_id % 5 = 0 THEN -1 ELSE k END AS BIGINT) AS audio_ctx, k / 8.0::DOUBLE AS word_threshold, 2.4::DOUBLE AS entropy_threshold,
-1.0::DOUBLE AS logprob_threshold, 0.6::DOUBLE AS no_speech_threshold, CASE WHEN event_id % 7 = 0 THEN 'verbose_json' ELSE 'json' END AS response_format, false AS diarize, k * 10 AS offset_ms, CAST(0 AS BIGINT) AS duration_ms, 6 AS rungs FROM k""",
)
def form_options(spark, d):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id")
    asked = {
        "language": F.when(n % 3 == 0, "auto").otherwise("de"),
        "translate": F.when(n % 2 == 0, "1").otherwise("no"),
        "tinydiarize": F.lit("TRUE"),
        "suppress_nst": F.when(n % 2 == 1, "true").otherwise("0"),
        "prompt": F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("p"), k)),
        "max_context": (k.cast("long") * 2).cast("string"),
        "max_len": F.lit("-3"),
        "beam_size": F.when(n % 5 == 0, "many").otherwise(k),
        "audio_ctx": F.when(n % 5 == 0, " 7").otherwise(k),
        "word_thold": (k.cast("double") / 8).cast("string"),
        "temperature": F.lit("warm"),
        "response_format": F.when(n % 7 == 0, "verbose_json").otherwise("json"),
        "offset": F.concat(k, F.lit("0")),
        "duration": F.lit("long"),
    }
    fields = F.map_from_arrays(F.array(*map(F.lit, asked)), F.array(*asked.values()))
    o = X.form_options(F.col("f"))
    named = {**o, "language": F.coalesce(o["language"], F.lit("-")), "initial_prompt": F.coalesce(o["initial_prompt"], F.lit("-")), "audio_ctx": F.coalesce(o["audio_ctx"], F.lit(-1))}
    rungs = F.size(X.ladder(named.pop("temperature"), named.pop("temperature_inc")))
    return table(spark, d, "events").select("event_id", fields.alias("f")).select("event_id", *[c.alias(x) for x, c in named.items() if x != "best_of"], rungs.alias("rungs"))


@query("multipart_fields", "SELECT event_id, event_type AS kind, props AS file FROM events")
def multipart_fields(spark, d):
    part = lambda n, v: F.concat(F.lit(f'--XbX\r\nContent-Disposition: form-data; name="{n}"\r\n\r\n'), v, F.lit("\r\n"))
    body = F.concat(part("kind", F.col("event_type")), part("file", F.col("props")), F.lit("--XbX--\r\n"))
    e = table(spark, d, "events").select("event_id", X.multipart(body, F.lit("XbX")).alias("m"))
    return e.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["file"].alias("file"))


@query("static_routes", "SELECT page_id, NOT contains(url, '/..') AS safe, CASE WHEN url LIKE '%.html' THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END AS mime FROM pages")
def static_routes(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_path(F.col("url")).alias("safe"), X.mime(F.col("url")).alias("mime"))


@query("command_list", "SELECT item_id, lower(trim(text)) AS command FROM benchmark WHERE trim(text) <> ''")
def command_list(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.lower(F.trim("text")).alias("command")).where("command <> ''")


@query("joined_text", r"SELECT conv_id, string_agg(trim(text, E' \t\n\r\v\f'), ' ' ORDER BY turn) AS text, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def joined_text(spark, d):
    """Each conversation's segments as one text."""
    return X.joined_text(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("model_types", "SELECT l_quantity, CASE CAST(l_quantity AS INT) WHEN 4 THEN 'tiny' WHEN 6 THEN 'base' WHEN 12 THEN 'small' WHEN 24 THEN 'medium' WHEN 32 THEN 'large' ELSE 'unknown' END AS kind, count(*) AS n, CAST(sum(CASE WHEN 51840 + l_quantity >= 51865 THEN 1 ELSE 0 END) AS BIGINT) AS multilingual FROM lineitem GROUP BY l_quantity")
def model_types(spark, d):
    """What quantities would say as a model's layers, and, from 51840 on, as the size of its vocabulary."""
    q = table(spark, d, "lineitem").select("l_quantity", X.model_type(F.col("l_quantity").cast("int")).alias("kind"), X.is_multilingual(F.col("l_quantity") + 51840).alias("m"))
    return q.groupBy("l_quantity", "kind").agg(F.count("*").alias("n"), F.sum(F.col("m").cast("long")).alias("multilingual"))


@query(
    "load_path",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_type || '.bin' WHEN 1 THEN event_type WHEN 2 THEN NULL WHEN 3 THEN '{"model":"' || event_type || '"}' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN event_type || '/m' ELSE NULL END AS path FROM events""",
)
def load_path(spark, d):
    """Load requests: JSON with the model, plain text, JSON without it, JSON that is sent as text, nothing, an empty or a broken name."""
    kinds = [
        ("application/json", F.concat(F.lit('{"x":1,"model" : "'), "event_type", F.lit('.bin"}'))),
        (None, F.concat(F.lit("  "), "event_type", F.lit(" \n"))),
        ("application/json", F.lit('{"other":1}')),
        ("text/plain", F.concat(F.lit(' {"model":"'), "event_type", F.lit('"}'))),
        ("text/plain", F.lit(" \t\n")),
        ("application/json", F.lit('{"model":""}')),
        (" Application/JSON ; charset=utf-8", F.concat(F.lit('{"model":\n "'), "event_type", F.lit('/m","model":"second"}'))),
        ("application/json", F.lit('{"model": 7, "name":"x"}')),
    ]
    n = F.col("event_id") % len(kinds)
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in kinds]), (n + 1).cast("int"))
    body = F.element_at(F.array(*[b for _, b in kinds]), (n + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.load_path(kind, body).alias("path"))


def _heard(spark, d):
    """What users said, with the assistant's text if that comes next: (conv_id, turn, text, reply)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"_role": F.lead("role").over(w), "_text": F.lead("text").over(w)})
    return c.where("role = 'user'").select("conv_id", "turn", "text", F.when(F.col("_role") == "assistant", F.col("_text")).alias("reply"))


TURNS = r"""WITH c AS (SELECT conv_id, turn, role, trim(text, E' \t\n\r\v\f') AS heard, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, heard, CASE WHEN r2 = 'assistant' THEN trim(t2, E' \t\n\r\v\f') END AS reply FROM c WHERE role = 'user' AND heard <> ''),
m AS (SELECT *, '{"role":"user","content":' || to_json(heard) || '}' AS u, CASE WHEN reply IS NOT NULL THEN ',{"role":"user","content":' || to_json(heard) || '},{"role":"assistant","content":' || to_json(reply) || '}' END AS pair FROM t)
SELECT conv_id, turn, '{"model":"m","messages":[{"role":"system","content":"Be brief."}' || coalesce(string_agg(pair, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || ',' || u || ']}' AS request, reply FROM m"""


@query("chat_turns", TURNS)
def chat_turns(spark, d):
    """Each user turn's request, with all answered turns before it; a turn without a reply failed and is in no later request."""
    t = chat.chat_turns(_heard(spark, d), F.col("reply"), system="Be brief.")
    return t.select("conv_id", "turn", X.chat_body(F.lit("m"), F.col("messages")).alias("request"), "reply")


def _known_reply(messages, row):
    if row["reply"] is None:
        raise ValueError("no reply")
    return row["reply"]


@query("chat_turns_stream", TURNS)
def chat_turns_stream(spark, d):
    """The same as a stream of turns, with the history kept as state and the replies from a function that may fail."""
    turns = _heard(spark, d)
    path = f"{scratch(spark, 'turns')}/table"
    turns.write.parquet(path)
    replies = chat.chat_stream(spark.readStream.schema(turns.schema).parquet(path), _known_reply, system="Be brief.")
    with state_store(spark):
        out = sinks.drained(replies, "chat")
    return out.select("conv_id", "turn", X.chat_body(F.lit("m"), F.col("messages")).alias("request"), "reply")
