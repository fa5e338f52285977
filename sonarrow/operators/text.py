"""Text: matching, prompts, grammars, JSON, forms; tokens by longest match and compressibility as Arrow functions."""

from __future__ import annotations

import itertools
import re
from array import array
from collections import deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, in characters; two empty strings are alike, one empty one is not."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def first_words(text: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def split_prompt(text: Column, prompt: Column) -> tuple[Column, Column]:
    """As many words as the prompt has, and the rest."""
    words, n = F.split(text, " "), F.size(F.split(prompt, " "))
    return F.array_join(F.slice(words, 1, n), " "), F.array_join(F.when(F.size(words) > n, F.slice(words, n + 1, F.size(words))).otherwise(F.array()), " ")


def best_cut(df: DataFrame, keys: list[str], text: str, prompt: str) -> DataFrame:
    """(keys, cut, score): the prefix of text, of 0.8 to 1.2 times the prompt's length, most like it; the shortest of equals."""
    n = F.length(prompt)
    lo, hi = F.floor(n * 0.8), F.least(F.ceil(n * 1.2), F.length(text))
    d = df.where(lo <= hi).withColumn("cut", F.explode(F.sequence(lo, hi)))
    d = d.withColumn("score", similarity(F.expr(f"substring({text}, 1, cast(cut as int))"), F.col(prompt)))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "cut")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "cut", "score")


def accepts(score: Column) -> Column:
    return score > 0.7


def activates(score: Column, heard: Column, prompt: Column) -> Column:
    return (score >= 0.8) & (F.length(heard) / F.length(prompt)).between(0.8, 1.2)


#: Contractions, letters, digits and others each with an optional space before, and white space but its last byte.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def greedy_encoder(vocab: dict[bytes, int]):
    """An Arrow function from text to ids by longest match in each pre-token's bytes; unknown bytes are skipped.

    The vocabulary travels with the function; its size is the caller's to bound.
    """
    lengths = [sorted({len(w) for w in vocab if w[:1] == bytes([i])}, reverse=True) for i in range(256)]
    split = re.compile(PIECES.encode())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        known: dict[bytes, list[int]] = {}  # ids of short pieces, which come again

        def ids(piece):
            out, i = [], 0
            while i < len(piece):
                for n in lengths[piece[i]]:
                    if (k := vocab.get(piece[i : i + n])) is not None:
                        out.append(k)
                        i += n
                        break
                else:
                    i += 1
            if len(piece) <= 32 and len(known) < 100_000:
                known[piece] = out
            return out

        flat, ends = array("i"), array("i", [0])
        for s in text:
            out = []
            for piece in split.findall(s.as_py().encode()) if s.is_valid else ():
                out += ids(piece) if (k := known.get(piece)) is None else k
            flat.fromlist(out)
            ends.append(len(flat))
        numbers = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
        return pa.ListArray.from_arrays(numbers(ends), numbers(flat))

    return encode


def decode(df: DataFrame, keys: list[str], vocab: DataFrame) -> DataFrame:
    """Texts of (keys, k, id) by a join with vocab (id, bytes), put together in order and read as UTF-8."""
    d = df.join(vocab, "id").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", F.hex("bytes").alias("h")))).alias("s"))
    return d.select(*keys, F.decode(F.unhex(F.array_join(F.col("s.h"), "")), "UTF-8").alias("text"))


@F.pandas_udf(T.DoubleType())
def compressibility(text: pd.Series) -> pd.Series:
    """Bytes over an estimate of their compressed size: 12, 1 a literal, 4 a match of 4 to 255 bytes within 1024 back; 1 if empty."""

    def one(s):
        if s is None:
            return None
        b = s.encode()
        cost, i, seen = 12, 0, {}
        while i < len(b):
            best = 0
            for j in reversed(seen.get(b[i : i + 4], ())):
                n = 4
                while n < 255 and i + n < len(b) and b[j + n] == b[i + n]:
                    n += 1
                best = max(best, n)
                if best == 255:
                    break
            step = best if best >= 4 and len(b) - i >= 4 else 1
            cost += 4 if step > 1 else 1
            for k in range(i, min(i + step, len(b) - 3)):
                seen.setdefault(b[k : k + 4], deque()).append(k)
                if k >= 1024:  # too far back for what follows
                    old = b[k - 1024 : k - 1020]
                    seen[old].popleft()
                    if not seen[old]:
                        del seen[old]
            i += step
        return len(b) / cost if b else 1.0

    return text.map(one)


MOST_CANDIDATES = 4096


def grammar(rules: str, root: str = "root") -> list[str]:
    """All strings of a finite grammar, sorted: rules `name ::= a | b`, quoted literals, names, parentheses, # comments.

    Classes, repetition, cycles, unknown names, alternatives inside parentheses and over 4096 strings raise ValueError.
    """
    parsed: dict[str, list[list]] = {}
    for line in rules.splitlines():
        tokens = re.findall(r'"(?:\\.|[^"\\])*"|::=|[A-Za-z_][\w-]*|\S', re.sub(r'#(?=(?:[^"]*"[^"]*")*[^"]*$).*', "", line))
        if not tokens:
            continue
        if len(tokens) < 3 or tokens[1] != "::=":
            raise ValueError(f"not a rule: {line}")
        options, depth = [[]], 0
        for t in tokens[2:]:
            if t == "|" and not depth:
                options.append([])
            elif t == "(":
                depth += 1
            elif t == ")" and depth:
                depth -= 1
            elif t[0] == '"':
                options[-1].append(("text", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1])))
            elif re.match(r"[A-Za-z_]", t):
                options[-1].append(("rule", t))
            else:
                raise ValueError(f"not supported: {t}")
        if depth:
            raise ValueError("a parenthesis is open")
        parsed.setdefault(tokens[0], []).extend(options)

    def expand(name, above):
        if name in above:
            raise ValueError(f"a cycle through {name}")
        if name not in parsed:
            raise ValueError(f"no rule {name}")
        out = set()
        for option in parsed[name]:
            parts = [[x] if kind == "text" else expand(x, (*above, name)) for kind, x in option]
            for p in itertools.product(*parts):
                out.add("".join(p))
                if len(out) > MOST_CANDIDATES:
                    raise ValueError("too many strings")
        return sorted(out)

    return expand(root, ())


@F.pandas_udf(T.ArrayType(T.StringType()))
def grammar_strings(rules: pd.Series) -> pd.Series:
    """All strings of each row's grammar, sorted; null for a null and for what is no finite grammar of at most 4096 strings."""

    def one(r):
        try:
            return None if r is None else grammar(r)
        except ValueError:
            return None

    return rules.map(one)


def chat_body(model: Column, messages: Column, **options: Column) -> Column:
    """The JSON of a chat request; options that are null are left out."""
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), *[v.alias(k) for k, v in options.items()]))


def chat_reply(body: Column) -> Column:
    """The first choice's content, else the error's message, else the body."""
    return F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.get_json_object(body, "$.error.message"), body)


def persona(template: Column, *values: Column) -> Column:
    for i, v in enumerate(values):
        template = F.replace(template, F.lit(f"{{{i}}}"), v)
    return template


def form_options(fields: Column) -> dict[str, Column]:
    """Options of a request's fields (map), null or their default where absent.

    A number that does not parse, or a negative one where there are none, counts as absent; flags are set by true or 1; the
    language auto and an empty prompt are none.
    """
    get = lambda k: F.try_element_at(fields, F.lit(k))
    whole = lambda k: F.when(get(k).rlike(r"^\+?[0-9]+$"), get(k).try_cast("long"))
    number = lambda k, default: F.coalesce(F.when(get(k).rlike(r"^\S+$"), get(k).try_cast("double")), F.lit(default))
    flag = lambda k: F.coalesce(get(k).isin("true", "1"), F.lit(False))
    return {
        "language": F.when(get("language") != "auto", get("language")),
        "translate": flag("translate"),
        "tinydiarize": flag("tinydiarize"),
        "suppress_non_speech": flag("suppress_nst"),
        "carry_initial_prompt": flag("carry_initial_prompt"),
        "initial_prompt": F.nullif(get("prompt"), F.lit("")),
        "max_context": whole("max_context"),
        "max_len": F.coalesce(whole("max_len"), F.lit(0)),
        "best_of": F.coalesce(whole("best_of"), F.lit(5)),
        "beam_size": F.coalesce(whole("beam_size"), F.lit(5)),
        "audio_ctx": whole("audio_ctx"),
        "word_threshold": number("word_thold", 0.01),
        "entropy_threshold": number("entropy_thold", 2.4),
        "logprob_threshold": number("logprob_thold", -1.0),
        "no_speech_threshold": number("no_speech_thold", 0.6),
        "temperature": number("temperature", 0.0),
        "temperature_inc": number("temperature_inc", 0.2),
        "response_format": F.coalesce(get("response_format"), F.lit("json")),
        "diarize": flag("diarize"),
        "offset_ms": F.coalesce(whole("offset"), F.lit(0)),
        "duration_ms": F.coalesce(whole("duration"), F.lit(0)),
    }


def ladder(start: Column, step: Column) -> Column:
    """The temperatures start, start + step, ... up to 1 as an array; a step that is not positive gives start alone."""
    n = F.greatest(F.floor((F.lit(1 + 1e-6) - start) / step + 1e-9), F.lit(0)).cast("int")
    return F.when(step > 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.least(F.lit(1.0), start + i * step))).otherwise(F.array(start))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\v\f"))


def joined_text(segments: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, text, n): the trimmed texts of a transcript's segments in order, with a blank between them."""
    g = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), trimmed(F.col(text)).alias("t")))).alias("s"), F.count("*").alias("n"))
    return g.select(*keys, F.array_join(F.col("s.t"), " ").alias("text"), "n")


def model_type(layers: Column) -> Column:
    """A model's size by its number of encoder layers."""
    # fixed values of the format
    sizes = {4: "tiny", 6: "base", 12: "small", 24: "medium", 32: "large"}
    out = F.lit("unknown")
    for n, name in sizes.items():
        out = F.when(layers == n, name).otherwise(out)
    return out


def is_multilingual(vocabulary: Column) -> Column:
    return vocabulary >= 51865


def load_path(content_type: Column, body: Column) -> Column:
    """The model named by a load request: a JSON body's string field, else the trimmed body; null if there is none.

    The content type says which it is; of several fields of the name the first counts, and one that is no string is none.
    """
    is_json = F.lower(trimmed(F.split(content_type, ";")[0])) == "application/json"
    field = F.regexp_extract(body, r'(?s)^.*?"model"[^:]*:\s*+(?:"([^"]*)")?', 1)
    return F.nullif(F.when(F.coalesce(is_json, F.lit(False)), field).otherwise(trimmed(body)), F.lit(""))


def multipart(body: Column, boundary: Column) -> Column:
    """Fields of a text multipart body as a map from name to value."""
    parts = F.filter(F.split(body, F.concat(F.lit("--\\Q"), boundary, F.lit("\\E"))), lambda p: p.contains("\r\n\r\n"))
    field = lambda p: F.struct(F.regexp_extract(p, r'name="([^"]*)"', 1).alias("k"), F.regexp_replace(F.regexp_extract(p, r"(?s)\r\n\r\n(.*)$", 1), r"\r\n$", "").alias("v"))
    return F.map_from_entries(F.transform(parts, field))


def safe_path(path: Column) -> Column:
    return ~F.array_contains(F.split(path, "/"), "..")


def mime(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"html": "text/html; charset=utf-8", "js": "text/javascript", "css": "text/css", "json": "application/json", "wasm": "application/wasm"}
    out = F.lit("application/octet-stream")
    for k, v in kinds.items():
        out = F.when(ext == k, v).otherwise(out)
    return out
