"""Lookup tables that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Language codes in order of their ids, and the English names in the same order.
LANGUAGE_CODES = """
en zh de es ru ko fr ja pt tr pl ca nl ar sv it id hi fi vi he uk el ms cs ro da hu ta no th ur hr bg lt la mi ml cy
sk te fa lv bn sr az sl kn et mk br eu is hy ne mn bs kk sq sw gl mr pa si km sn yo so af oc ka be tg sd gu am yi lo
uz fo ht ps tk nn mt sa lb my bo tl mg as tt haw ln ha ba jw su yue
""".split()

LANGUAGE_NAMES = """
english, chinese, german, spanish, russian, korean, french, japanese, portuguese, turkish, polish, catalan, dutch,
arabic, swedish, italian, indonesian, hindi, finnish, vietnamese, hebrew, ukrainian, greek, malay, czech, romanian,
danish, hungarian, tamil, norwegian, thai, urdu, croatian, bulgarian, lithuanian, latin, maori, malayalam, welsh,
slovak, telugu, persian, latvian, bengali, serbian, azerbaijani, slovenian, kannada, estonian, macedonian, breton,
basque, icelandic, armenian, nepali, mongolian, bosnian, kazakh, albanian, swahili, galician, marathi, punjabi,
sinhala, khmer, shona, yoruba, somali, afrikaans, occitan, georgian, belarusian, tajik, sindhi, gujarati, amharic,
yiddish, lao, uzbek, faroese, haitian creole, pashto, turkmen, nynorsk, maltese, sanskrit, luxembourgish, myanmar,
tibetan, tagalog, malagasy, assamese, tatar, hawaiian, lingala, hausa, bashkir, javanese, sundanese, cantonese
"""
LANGUAGE_NAMES = [x.strip() for x in LANGUAGE_NAMES.replace("\n", " ").split(",")]

# For each model size the (layer, head) pairs whose cross-attention follows time.
ALIGNMENT_HEADS = {
    "tiny.en": "1:0 2:0 2:5 3:0 3:1 3:2 3:3 3:4",
    "tiny": "2:2 3:0 3:2 3:3 3:4 3:5",
    "base.en": "3:3 4:7 5:1 5:5 5:7",
    "base": "3:1 4:2 4:3 4:7 5:1 5:2 5:4 5:6",
    "small.en": "6:6 7:0 7:3 7:8 8:2 8:5 8:7 9:0 9:4 9:8 9:10 10:0 10:1 10:2 10:3 10:6 10:11 11:2 11:4",
    "small": "5:3 5:9 8:0 8:4 8:7 8:8 9:0 9:7 9:9 10:5",
    "medium.en": "11:4 14:1 14:12 14:14 15:4 16:0 16:4 16:9 17:12 17:14 18:7 18:10 18:15 20:0 20:3 20:9 20:14 21:12",
    "medium": "13:15 15:4 15:15 16:1 20:0 23:4",
    "large.v1": "9:19 11:2 11:4 11:17 22:7 22:11 22:17 23:2 23:15",
    "large.v2": "10:12 13:17 16:11 16:12 16:13 17:15 17:16 18:4 18:11 18:19 19:11 21:2 21:3 22:3 22:9 22:12 23:5 23:7 23:13 25:5 26:1 26:12 27:15",
    "large.v3": "7:0 10:17 12:18 13:12 16:1 17:14 19:11 21:4 24:1 25:6",
    "large.v3.turbo": "2:4 2:11 3:3 3:6 3:11 3:14",
}


def languages(spark: SparkSession) -> DataFrame:
    """(id, code, name), a row for each of 100 languages."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(zip(LANGUAGE_CODES, LANGUAGE_NAMES, strict=True))], "id int, code string, name string")


def alignment_heads(spark: SparkSession) -> DataFrame:
    """(preset, layer, head)."""
    pairs = [(p, *map(int, x.split(":"))) for p, h in ALIGNMENT_HEADS.items() for x in h.split()]
    return spark.createDataFrame(pairs, "preset string, layer int, head int")
