"""Checks and cleaning of texts that users send, and redaction of secrets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevia.functions.patterns import Pattern, any_of

#: How prompts are injected.
INJECTION = (
    Pattern(r"ignore\s+(all\s+)?(previous|above|earlier)\s+(instructions?|prompts?|commands?)", needs=("ignore",)), Pattern(r"forget\s+(all\s+)?(previous|above|earlier)\s+(instructions?|prompts?|commands?)", needs=("forget",)),
    Pattern(r"disregard\s+(all\s+)?(previous|above|earlier)\s+(instructions?|prompts?|commands?)", needs=("disregard",)), Pattern(r"override\s+(the\s+)?(system|default|original)\s+instructions?", needs=("override",)),
    Pattern(r"\bsystem\s*:\s*", needs=("system", ":")), Pattern(r"\bassistant\s*:\s*", needs=("assistant", ":")), Pattern(r"\buser\s*:\s*", needs=("user", ":")), Pattern(r"\bmodel\s*:\s*", needs=("model", ":")),
    Pattern(r"\[INST\].*?\[/INST\]", "is", needs=("[inst]", "[/inst]")), Pattern(r"<\|im_start\|>\s*(system|assistant|user)", needs=("<|im_start|>",)), Pattern(r"<\|im_end\|>", needs=("<|im_end|>",)),
    Pattern(r"\b(jailbreak|jail\s*break)\b", needs=("jail", "break")), Pattern(r"\b(dan|developer\s*mode|developer\s*mode\s*on)\b", needs=(("dan", "developer"),)),
    Pattern(r"you\s+are\s+now\s+(a|an)\s+", needs=("now", "you", "are")), Pattern(r"act\s+as\s+(a|an)\s+", needs=("act", "as")), Pattern(r"pretend\s+(to\s+be\s+)?(a|an)\s+", needs=("pretend",)), Pattern(r"role\s*play\s+as\s+(a|an)\s+", needs=("role", "play")),
    Pattern(r"assume\s+(the\s+)?role\s+of\s+(a|an)\s+", needs=("assume", "role")), Pattern(r"from\s+now\s+on", needs=("now", "from")), Pattern(r"from\s+this\s+point\s+forward", needs=("point", "forward")), Pattern(r"starting\s+now", needs=("starting", "now")),
    Pattern(r"for\s+the\s+rest\s+of\s+this\s+(conversation|chat)", needs=(("conversation", "chat"), "rest", "this")), Pattern(r"^\s*\}\s*\{\s*", start=True), Pattern(r"^\s*\]\s*\[\s*", start=True), Pattern(r'^\s*\{.*".*"\s*:\s*".*".*\}\s*$', needs=("{", "}", ":", '"')),
    Pattern(r"__import__\s*\(", needs=("__import__",)), Pattern(r"exec\s*\(", needs=("exec", "(")), Pattern(r"eval\s*\(", needs=("eval", "(")), Pattern(r"\$\{.*?\}", needs=("${", "}")), Pattern(r"\{\{.*?\}\}", needs=("{{", "}}")), Pattern(r"\{%.*?%\}", needs=("{%", "%}")),
    Pattern(r"<prompt>.*?</prompt>", "is", needs=("<prompt>", "</prompt>")),
)
#: Most characters of an input; zero-width characters, special characters in a row, share of visible
#: characters, strange characters; characters that the last two look at.
MOST, ZERO_WIDTH, IN_A_ROW, VISIBLE, STRANGE, LOOKED_AT = 10_000, 5, 3, 0.3, 50, 2000
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\u009F]"
SPECIAL = r"[!@#$%^&*()_+=\[\]{};:'" + r'"<>?/\\|`~]'


def injected(text: Column) -> Column:
    """N6."""
    t = F.coalesce(text, F.lit(""))
    return (F.trim(t) != "") & any_of(INJECTION, t)


def sanitised(text: Column, most: int = MOST) -> Column:
    """Cut to `most` characters, control characters out, roles no longer before a colon, blanks and blank lines collapsed,
    trimmed."""
    t = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, most), CONTROL, "")
    for role in ("system", "assistant", "user"):
        t = Pattern(rf"\b{role}\s*:\s*").replaced(t, f"{role} : ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def validated(text: Column, most: int = MOST) -> Column:
    """struct<clean, suspicious, warnings>."""
    t = F.coalesce(text, F.lit(""))
    clean, bad, n = sanitised(t, most), injected(t), F.length(t)
    said = F.array(
        F.when(bad, "Potential injection patterns detected in input"),
        F.when(n > most, F.concat(F.lit("Input truncated from "), n.cast("string"), F.lit(f" to {most} characters"))),
        F.when(t.rlike(CONTROL), "Control characters removed from input"),
        F.when((clean != "") & (F.length(clean) < n * 0.5), "More than 50% of content was removed during sanitization"),
    )
    return F.struct(clean.alias("clean"), bad.alias("suspicious"), F.array_compact(said).alias("warnings"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def reason(text: Column, most: int = MOST, visible_of: int = LOOKED_AT, injection: bool = True) -> Column:
    """The first reason for refusing a text, or ok."""
    head = F.substring(text, 1, visible_of)
    visible = _count(head, r"[\p{L}\p{N}\p{P}\p{S}]") / F.length(head)
    return (
        F.when(text.isNull(), "empty")
        .when(F.length(text) > most, "too_long")
        .when(F.regexp_replace(text, r"(?U)\s", "") == "", "empty")
        .when(text.rlike(CONTROL), "control_chars")
        .when(_count(text, r"[\u200B-\u200D\u2060\uFEFF]") > ZERO_WIDTH, "zero_width_abuse")
        .when(text.rlike(SPECIAL + f"{{{IN_A_ROW},}}"), "special_char_flood")
        .when((visible < VISIBLE) & (F.length(text) > 50), "invisible_flood")
        .when(_count(head, r"[\uE000-\uF8FF\x{30000}-\x{10FFFF}]") > STRANGE, "unicode_flood")
        .when(injected(text) & F.lit(injection), "injection_detected")
        .otherwise("ok")
    )


def fingerprint(text: Column) -> Column:
    """Lower case, only word characters, the first hundred."""
    return F.substring(F.regexp_replace(F.lower(text), r"(?U)[^\w]", ""), 1, 100)


#: Pattern, mask, and whether a partial mask may keep both ends; applied in this order.
SECRETS = (
    (Pattern(r"[MN][A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{20,}", ""), "***DISCORD_TOKEN***", False),
    (Pattern(r"sk-ant-[a-zA-Z0-9_-]{10,}", ""), "sk-ant-***REDACTED***", True),
    (Pattern(r"sk-(?:proj-)?[A-Za-z0-9_-]{10,}", ""), "sk-***REDACTED***", True),
    (Pattern(r"AIza[A-Za-z0-9_-]{20,}", ""), "AIza***REDACTED***", True),
    (Pattern(r"Bearer\s+[A-Za-z0-9_-]{10,}"), "Bearer ***REDACTED***", True),
    (Pattern(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ""), "***EMAIL***", False),
    (Pattern(r"\d{3}\.\d{3}\.\d{3}-\d{2}", ""), "***CPF***", False),
    (Pattern(r"(?<!\d)\d{11}(?!\d)", ""), "***CPF***", False),
    (Pattern(r"(?:\+?55\s?)?\(?\d{2,3}\)?\s?\d{4,5}-?\d{4}", ""), "***TELEFONE***", False),
    (Pattern(r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}", ""), "***CARD***", False),
    (Pattern(r"""(senha|password|secret)['":\s]*[^\s'"`]{4,}"""), "***CREDENTIAL***", False),
)


def redact(text: Column) -> Column:
    """Every secret replaced by its mask."""
    return reduce(lambda t, s: s[0].replaced(t, s[1]), SECRETS, text)


def redact_partly(text: Column) -> Column:
    """As redact(), but of keys the first and last four characters stay if they are longer than eight. All that a key
    leaves is its ends, so masks made before aren't masked anew."""

    return reduce(lambda t, s: _ends_of(t, s[0]) if s[2] else s[0].replaced(t, s[1]), SECRETS, text)


def _ends_of(text: Column, pattern: Pattern) -> Column:
    """Each match replaced by its first and last four characters around ***; the pieces between the matches stay."""
    found, between = F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0)), F.split(text, pattern.java)
    short = F.transform(found, lambda m: F.when(F.length(m) > 8, F.concat(F.substring(m, 1, 4), F.lit("***"), F.right(m, F.lit(4)))).otherwise("***REDACTED***"))
    pairs = F.zip_with(between, F.concat(short, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(pairs, ""))


def redact_json(value: Column, schema: str) -> Column:
    """N10 over all strings of a JSON text of this schema (strings, and arrays and maps of them, however deep)."""
    from pyspark.sql import types as T

    def walk(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redact(x)
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda y: walk(y, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(x, lambda _, y: walk(y, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.struct(*[walk(x[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return x

    kind = T._parse_datatype_string(schema)
    return F.to_json(walk(F.from_json(value, schema), kind))


#: Words that a query's flags look for.
FLAGS = {"artigo": ("art.", "artigo"), "lei": ("lei",), "constituicao": ("constituição", "cf/88"), "stf": ("stf",), "stj": ("stj",), "concurso": ("concurso", "banca"), "crime": ("crime",)}


def complexity(text: Column) -> Column:
    """Words, characters, their ratio, a bucket and which kinds of words stand in a query."""
    t = F.coalesce(text, F.lit(""))
    words, chars, low = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")), F.length(t), F.lower(t)
    flags = [reduce(lambda a, w: a | low.contains(w), words_, F.lit(False)).alias(name) for name, words_ in FLAGS.items()]
    return F.struct(
        words.alias("words"), chars.alias("chars"), F.round(F.when(words > 0, chars / words).otherwise(0.0), 2).alias("chars_per_word"),
        F.when(words <= 5, "short").when(words <= 15, "medium").otherwise("long").alias("bucket"), *flags,
    )


def html_escaped(text: Column) -> Column:
    """N13."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def duration_text(seconds: Column) -> Column:
    """Milliseconds, seconds, minutes or hours, whichever reads best."""
    tenths = lambda x: F.format_string("%.1f", F.bround(x, 1))
    minutes, rest = F.floor(seconds % 3600 / 60).cast("string"), F.concat(tenths(seconds % 60), F.lit("s"))
    return (
        F.when(seconds < 1, F.concat(tenths(seconds * 1000), F.lit("ms")))
        .when(seconds < 60, F.concat(tenths(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), rest))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h "), minutes, F.lit("m "), rest))
    )
