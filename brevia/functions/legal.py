"""Metadata of legal texts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.functions.patterns import DIGIT, Pattern, any_of, plain

#: What stands for an article, a paragraph, an item, a law, a date and other references.
ARTICLE = Pattern(r"\bArt\.?\s*([0-9]+(?:-[A-Za-z])?)(?:\s*[º°o])?\b", needs=("art",))
PARAGRAPH = Pattern(r"(?:§+\s*([0-9]+|[Uu][Nn][ÍI]?[Cc][Oo])(?:\s*[º°o])?|par[aá]grafo\s+([úu]nico|\d+)(?:\s*[º°o])?)", needs=(("§", "grafo"),))
ITEM = Pattern(r"(?:^|\n)\s*(?:inciso\s+)?([IVXLCDM]{1,15})\s*(?:[-–—.)]|$)", "im")
#: What an item is in plain() letters, for a first look at texts of which those are there.
ITEM_LOW = r"(?mUd)^\s*(?:inciso\s+)?[ivxlcdm]{1,15}\s*(?:[-–—.)]|$)"
ROMAN = Pattern(r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
BOARD = Pattern(r"\b(CEBRASPE|FCC|VUNESP|FGV|CESGRANRIO|CEPEC|IADES|CESPE|FUMARC|MP[A-Z]{2}|PGE[A-Z]{2}|TJ[A-Z]{2}|TRF\d|PC[A-Z]{2}|DPE[A-Z]{2}|MPF|MPU|MPT|MPE)\b", needs=(("cebraspe", "fcc", "vunesp", "fgv", "cesgranrio", "cepec", "iades", "cespe", "fumarc", "mp", "pge", "tj", "trf", "pc", "dpe"),))
YEAR = Pattern(r"\b(19\d{2}|20\d{2})\b", "", needs=(("19", "20"),))
LAW = Pattern(r"\b(?:Lei|LC|EC)\s*(?:n[ºo°]\s*)?(\d{1,5}(?:\.\d{3})*(?:/\d{2,4})?)\b", needs=(("lei", "lc", "ec"), DIGIT))
UPDATED_BY = Pattern(r"(?:inclu[ií]do|alterad[oa]|reda[cç][ãa]o dada)\s+pela\s+Lei\s*(?:n[ºo°]\s*)?(\d{1,5}(?:\.\d{3})*(?:/\d{2,4})?)", needs=("pela", "lei"))
DATE = Pattern(r"\b([0-3]\d/[01]\d/(?:19|20)\d{2})\b", "", needs=("/", ("19", "20")))
EXAM_REFERENCE = Pattern(r"\(([A-Z0-9]{2,10})-(19\d{2}|20\d{2})\)", "", needs=("(", "-", ("19", "20")))
EXAM_MARK = Pattern(r"([A-Z0-9]{2,12})(?:[-/\s]+)(19\d{2}|20\d{2})(?:[-/\s]+([A-Z]{3,12}))?", "", needs=(("19", "20"),))
NO_EXAM = ("STF", "STJ", "INFO", "ART")
PRECEDENT = Pattern(r"\b(?:Info(?:rmativo)?\s*\d+|S[uú]mula\s+[A-Z]?\d+)\b", needs=(("info", "mula"),))
AMENDMENT_NUMBER = Pattern(r"\bec\s*(?:n[ºo°]\s*)?\d+", "", needs=("ec", DIGIT))
#: The marks of a text, by name.
MARKS = {
    "attention": Pattern(r"#Atenção:", needs=("#aten",)),
    "stf": Pattern(r"\(STF\)|STF\s*:|#STF:|Supremo Tribunal Federal", needs=(("stf", "supremo tribunal federal"),)),
    "stj": Pattern(r"\(STJ\)|STJ\s*:|#STJ:|Superior Tribunal de Justiça", needs=(("stj", "superior tribunal de justi"),)),
    "exam": Pattern(r"#Concurso:|\([A-Z]{3,6}-\d{4}\)|Questão|cargo|concurso", needs=(("concurso", "(", "quest", "cargo"),)),
    "crime": Pattern(r"\bcrim[ea]s?\b|(?:homic[íi]dio|roubo|furto|latroc[íi]nio|estelionato|corrup[cç][ã]o|falsifica[cç][ã]o)\b", needs=(("crim", "homic", "roubo", "furto", "latroc", "estelionato", "corrup", "falsifica"),)),
    "penalty": Pattern(r"\bpena\s*(?:de|reclus[ã]ao|deten[cç][ã]ao|multa|pris[ã]ao)\b", needs=("pena",)),
    "heinous": Pattern(r"\bcrimes?\s+hediondos?\b|lei\s+8\.?072\b", needs=(("hediondo", "072"),)),
    "prosecution": Pattern(r"\ba[cç][ã]o\s+penal\s*(?:p[úu]blica|privada)\b", needs=("penal",)),
    "military": Pattern(r"\b(codigo?\s*penal\s*militar|crime?\s+militar|justi[cç]a\s+militar)\b", needs=("militar",)),
    "tcu": Pattern(r"\(TCU\)|TCU\s*:|#TCU:|Tribunal\s+de\s+Contas\s+da\s+União", needs=(("tcu", "tribunal"),)),
}
#: Words that speak for commentary.
DOCTRINE = ("doutrina", "entendimento doutrin", "autor", "atenção", "comentário", "# atenção", "dica")


def article(text: Column, low: Column | None = None) -> Column:
    """E1."""
    return ARTICLE.first(text, low=low)


def paragraph(text: Column, low: Column | None = None) -> Column:
    """Its number, or único."""
    return _paragraph(F.coalesce(PARAGRAPH.first(text, 1, low), PARAGRAPH.first(text, 2, low)))


def _paragraph(value: Column) -> Column:
    return F.when(F.lower(value).rlike("unico|único"), "único").otherwise(value)


def item(text: Column, low: Column | None = None) -> Column:
    """The first Roman number at a line's start that is one."""
    every = ITEM.every(text) if low is None else F.when(low.rlike(ITEM_LOW), ITEM.every(text))
    return F.get(F.filter(F.transform(every, lambda x: F.upper(x)), lambda r: r.rlike(ROMAN.java)), F.lit(0))


def marks(text: Column, low: Column | None = None) -> Column:
    """E4."""
    return F.struct(*[p.found(text, low).alias(name) for name, p in MARKS.items()])


def board(text: Column, low: Column | None = None) -> Column:
    """E5: the first examination board, as it is written."""
    return BOARD.first(text, low=low)


def year(text: Column, low: Column | None = None) -> Column:
    """E5: the last year."""
    return F.get(F.reverse(YEAR.every(text, low=low)), F.lit(0))


def exam_references(text: Column, low: Column | None = None) -> Column:
    """Distinct (source, year) of references like (ABC-2013), in order."""
    part = lambda x, g: F.regexp_extract(x, EXAM_REFERENCE.java, g)
    return F.array_distinct(F.transform(EXAM_REFERENCE.every(text, 0, low), lambda x: F.struct(part(x, 1).alias("source"), part(x, 2).cast("int").alias("year"))))


def exam_marks(text: Column, low: Column | None = None) -> Column:
    """Distinct (exam, year, board) of marks like ABC-2013-XYZ, in order."""
    part = lambda x, g: F.regexp_extract(x, EXAM_MARK.java, g)
    found = F.transform(EXAM_MARK.every(text, 0, low), lambda x: F.struct(part(x, 1).alias("exam"), part(x, 2).cast("int").alias("year"), F.nullif(part(x, 3), F.lit("")).alias("board")))
    return F.array_distinct(F.filter(found, lambda x: ~x["exam"].isin(*NO_EXAM)))


def law_number(text: Column, low: Column | None = None) -> Column:
    """E7."""
    return LAW.first(text, low=low)


def updated_by(text: Column, low: Column | None = None) -> Column:
    """E7."""
    return F.concat(F.lit("Lei "), UPDATED_BY.first(text, low=low))


def valid_from(text: Column, low: Column | None = None) -> Column:
    """The first dd/mm/yyyy as yyyy-mm-dd."""
    return F.regexp_replace(DATE.first(text, low=low), r"^(\d\d)/(\d\d)/(\d{4})$", "$3-$2-$1")


def precedents(text: Column, low: Column | None = None) -> Column:
    """Distinct mentions of precedents, sorted."""
    return F.array_sort(F.array_distinct(F.transform(PRECEDENT.every(text, 0, low), lambda x: F.trim(x))))


def content_type(text: Column) -> Column:
    """The first kind that fits."""
    exam = MARKS["exam"].found(text) | EXAM_REFERENCE.found(text) | (F.size(exam_marks(text)) > 0)
    precedent = MARKS["stf"].found(text) | MARKS["stj"].found(text) | PRECEDENT.found(text)
    return _kind(exam, precedent, F.lower(text))


def _kind(exam: Column, precedent: Column, low: Column) -> Column:
    doctrine = F.lit(False)
    for word in DOCTRINE:
        doctrine = doctrine | low.contains(word)
    return F.when(exam, "exam_question").when(precedent, "jurisprudence").when(doctrine, "doctrine").otherwise("legal_text")


def source_type(text: Column, kind: Column) -> Column:
    """The kind of source of a text whose content_type is kind."""
    return _source(F.lower(text), kind)


def _source(low: Column, kind: Column, letters: Column | None = None) -> Column:
    """letters: plain() of the text, where it is there already."""
    same = F.when(kind == "doctrine", "commentary").when(kind.isin("jurisprudence", "exam_question"), kind)
    return F.coalesce(same, F.when(AMENDMENT_NUMBER.found(low, letters), "emenda_constitucional").otherwise("lei_cf"))


def status(text: Column) -> Column:
    """Revocation and veto with their scopes, how sure the times are, and the version in force."""
    states = _states(F.lower(text), valid_from(text), updated_by(text))
    return F.struct(*[c.alias(k) for k, c in states.items()])


def _states(low: Column, since: Column, law: Column) -> dict[str, Column]:
    gone, vetoed, part = low.contains("revogad"), low.contains("vetad"), low.contains("parcial")
    scope = lambda c: F.when(c & part, "partial").when(c, "total").otherwise("none")
    sure = F.when(since.isNotNull() & law.isNotNull(), 0.9).when(since.isNotNull() | law.isNotNull(), 0.6).when(gone | vetoed, 0.4).otherwise(0.1)
    version = F.concat(F.lit("pos_lei_"), F.translate(law, "/.", "_"))
    return {
        "is_revoked": gone, "is_vetoed": vetoed, "revocation_scope": scope(gone), "veto_scope": scope(vetoed),
        "temporal_confidence": sure, "version": F.coalesce(version, F.lit("current")),
    }


#: What the record calls the marks.
MARK_NAMES = {
    "attention": "marca_atencao", "stf": "marca_stf", "stj": "marca_stj", "exam": "marca_concurso", "crime": "marca_crime", "penalty": "marca_pena", "heinous": "marca_hediondo", "prosecution": "marca_acao_penal",
    "military": "marca_militar", "tcu": "marca_tcu",
}
#: Fields of the record that the text doesn't tell: they come from the chunk's context.
CONTEXT = ("documento", "law_name", "titulo", "capitulo", "secao", "tipo")


def described(df: DataFrame, text: str = "text", name: str = "meta", **context: Column) -> DataFrame:
    """Df with the record of its text as the struct column `name`, with the fields that filters, boosts and citations ask for.
    context: columns for the fields in CONTEXT. Each pattern goes over a text once; what others follow from is kept beside it. The
    struct is made of finished columns alone, so that Spark leaves out whatever nobody asks of it."""
    t, lower, low, own = F.col("_t"), F.col("_lower"), F.col("_plain"), {k: context[k].cast("string") if k in context else F.lit(None).cast("string") for k in CONTEXT}
    first, letters = {"_t": F.coalesce(F.col(text), F.lit(""))}, [{"_lower": F.lower(t)}, {"_plain": plain(t, lower)}]
    found = {f"_mark_{k}": p.found(t, low) for k, p in MARKS.items()} | {f"_own_{k}": c for k, c in own.items()} | {
        "_refs": exam_references(t, low), "_exams": exam_marks(t, low), "_law": updated_by(t, low), "_since": valid_from(t, low), "_precedents": precedents(t, low), "_article": article(t, low), "_board": board(t, low), "_year": year(t, low),
        "_number": law_number(t, low), "_section": F.when(PARAGRAPH.may(low), F.coalesce(PARAGRAPH.first(t, 1, low), PARAGRAPH.first(t, 2, low))), "_item": item(t, low),
    }
    focus = F.col("_mark_exam") | (F.size("_refs") > 0)
    precedent = F.col("_mark_stf") | F.col("_mark_stj") | (F.size("_precedents") > 0)
    then = {"_kind": _kind(focus | (F.size("_exams") > 0), precedent, lower), "_focus": focus, "_paragraph": _paragraph(F.col("_section"))} | {f"_is_{k}": c for k, c in _states(lower, F.col("_since"), F.col("_law")).items()}
    last = {"_source": _source(lower, F.col("_kind"), low), "_document": F.coalesce("_own_documento", F.lit("Unknown"))}
    fields = {
        "documento": "_document", "law_name": "_own_law_name", "law_number": "_number", "titulo": "_own_titulo", "capitulo": "_own_capitulo", "secao": "_own_secao",
        "artigo": "_article", "article": "_article", "paragrafo": "_paragraph", "inciso": "_item", "tipo": "_own_tipo", **{v: f"_mark_{k}" for k, v in MARK_NAMES.items()},
        "banca": "_board", "ano": "_year", "exam_references": "_refs", "exam_marks": "_exams", "valid_from": "_since", "updated_by_law": "_law",
        **{k: f"_is_{k}" for k in ("is_revoked", "is_vetoed", "revocation_scope", "veto_scope", "temporal_confidence")}, "effective_text_version": "_is_version", "is_exam_focus": "_focus", "jurisprudence_linked": "_precedents",
        "content_type": "_kind", "source_type": "_source",
    }
    steps = [first, *letters, found, then, last]
    for step in steps:
        df = df.withColumns(step)
    return df.withColumn(name, F.struct(*[F.col(c).alias(k) for k, c in fields.items()])).drop(*[c for step in steps for c in step])


#: How segments of an annotated constitution are told apart (the first kind that fits).
SEGMENTS = {
    "emenda_constitucional": (
        Pattern(r"Emenda\s+Constitucional\s+(?:n[º°]?\s*)?\d+"), Pattern(r"\bEC[-\s]\d+\b"), Pattern(r"Redação\s+dada\s+(?:ao|pela|pelo)\s+EC"),
        Pattern(r"(?:incluído|acrescido|renumerado|revogado)\s+pela\s+EC"), Pattern(r"\(EC\s+n[º°]?\s*\d+"),
    ),
    "adct": (Pattern(r"ADCT"), Pattern(r"Ato\s+das\s+Disposi[cç][õo]es\s+Constitucionais\s+Transit[óo]rias")),
    "jurisprudencia": (
        Pattern(r"\bSTF[\.\s,;)]", ""), Pattern(r"\bSTJ[\.\s,;)]", ""), Pattern(r"\bSúmula\s+(?:Vinculante\s+)?(\d+)\b"), Pattern(r"\bS[úu]mula\s+(?:do\s+)?STF\s+(\d+)\b"),
        Pattern(r"\bS[úu]mula\s+(?:do\s+)?STJ\s+(\d+)\b"), Pattern(r"\bEnunciado\s+(\d+)\b"), Pattern(r"\bInfo(?:rmativo)?\s+\d+"),
        Pattern(r"\b(?:RE|ADI|ADC|ADPF|HC|MS|RHC|MI|AI|ARE|Rcl|ACO|PET)\s+\d+\b", ""), Pattern(r"\bTese\s+(?:de\s+repercussão|do\s+STF|do\s+STJ)\b"), Pattern(r"\bAgR\b|\bED\b|\bembargos\s+de\s+declaração\b"),
    ),
    "questao_prova": (
        Pattern(r"\.mark\b", ""), Pattern(r"\b(?:CESPE|CEBRASPE|FCC|FGV|VUNESP|ESAF|QUADRIX|IBFC|IADES|AOCP)\b", ""),
        Pattern(r"\b(?:MPPR|MPPE|MPBA|MPSP|MPF|MPRS|MPSC|MPRJ|MPE[A-Z]{2})\s*[-–]\s*\d{4}\b", ""), Pattern(r"\b(?:TRF[1-6]?|TRT\d*|TCU|TCE|TRE|TST|STM)\s*[-–]\s*\d{4}\b", ""),
        Pattern(r"\b(?:PCPR|PCMG|PCSP|PCBA|PC[A-Z]{2})\s*[-–]\s*\d{4}\b", ""), Pattern(r"\bBL\s*(?:art\.|Art\.)\s*\d+"), Pattern(r"\b(?:Correto|Errado|CERTO|ERRADO)\b", ""),
    ),
    "comentario": (
        Pattern(r"^Aten[oõ][\.\s]", "im"), Pattern(r"^OBS[\s:\.]+", "im"), Pattern(r"^NOTA[\s:\.]+", "im"), Pattern(r"^DICA[\s:\.]+", "im"),
        Pattern(r"^(?:IMPORTANTE|ATENÇÃO|CUIDADO)[\s:\.]+", "im"), Pattern(r"Ateno\.mark"),
    ),
}
DEFAULT_SEGMENT = "lei_cf"


def segment(text: Column) -> Column:
    """The kind of a segment, and which marks it gets."""
    t = F.trim(F.coalesce(text, F.lit("")))
    kind = F.lit(DEFAULT_SEGMENT)
    for name, patterns in reversed(list(SEGMENTS.items())):
        kind = F.when(any_of(patterns, t), name).otherwise(kind)
    note = any_of(SEGMENTS["comentario"], t)
    court = lambda name: (kind == "jurisprudencia") & t.rlike(rf"(?U)\b{name}\b")
    return F.struct(
        kind.alias("source_type"), court("STF").alias("stf"), court("STJ").alias("stj"), (kind == "questao_prova").alias("exam"),
        (kind.isin("emenda_constitucional", "adct", "comentario") & note).alias("attention"),
    )


#: What a line of a legal document is (the first that fits), with the level of headings.
LINES = (
    ("titulo", Pattern(r"^\s*T[ÍI]TULO\s+([IVXLCDM]+|\d+)\b", start=True), 1),
    ("capitulo", Pattern(r"^\s*CAP[ÍI]TULO\s+([IVXLCDM]+|\d+)\b", start=True), 2),
    ("secao", Pattern(r"^\s*SE[CÇ][ÃA]O\s+([IVXLCDM]+|\d+)\b", start=True), 3),
    ("subsecao", Pattern(r"^\s*SUBSE[CÇ][ÃA]O\s+([IVXLCDM]+|\d+)\b", start=True), 4),
    ("artigo", Pattern(r"^\s*Art\.?\s*([0-9]+(?:-[A-Za-z])?)(?:\s*[º°o])?\b", start=True), None),
    ("paragrafo", Pattern(r"^\s*(?:§+\s*([0-9]+|[Uu][Nn][ÍI]?[Cc][Oo])(?:\s*[º°o])?|Par[áa]grafo\s+([ÚUu]nico|\d+)(?:\s*[º°o])?)\b", start=True), None),
    ("inciso", Pattern(r"^\s*(?:Inciso\s+)?([IVXLCDM]{1,15})\s*(?:[-–—.)]|$)", start=True), None),
    ("nota", Pattern(r"^\s*(?:nota(?:\s+de\s+rodap[eé])?|observa[cç][ãa]o|coment[aá]rio|n\.?\s*b\.?)\s*[:\-]", start=True), None),
    ("revogacao", Pattern(r"\b(?:revogad[oa]|vetad[oa]|reda[cç][ãa]o\s+dada\s+pela)\b"), None),
)


def line_kind(text: Column) -> Column:
    """(kind, value, level) of a line; nulls where it is none."""
    kind, value, level = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, pattern, depth in reversed(LINES):
        here = pattern.found(text)
        own = F.lit(None).cast("string")
        if name not in ("nota", "revogacao"):
            own = F.coalesce(pattern.first(text, 1), pattern.first(text, 2)) if name == "paragrafo" else pattern.first(text)
            own = F.upper(own) if name == "inciso" else own
        kind, value, level = F.when(here, name).otherwise(kind), F.when(here, own).otherwise(value), F.when(here, F.lit(depth).cast("int")).otherwise(level)
    return F.struct(kind.alias("kind"), value.alias("value"), level.alias("level"))


#: Words of heading styles.
HEADINGS = ("heading", "título", "titulo", "cabeçalho", "cabecalho", "title", "header")


def heading_level(style: Column) -> Column:
    """1 to 9 of a heading's style, else null. Of several the first word's smallest."""
    low = F.lower(style)
    level = F.lit(None).cast("int")
    for word in reversed(HEADINGS):
        for n in range(9, 0, -1):
            level = F.when(low.contains(f"{word} {n}") | low.contains(f"{word}{n}"), n).otherwise(level)
    return level


#: What tells transitional provisions and amendments.
TRANSITIONAL = Pattern(r"\bADCT\b|Ato\s+das\s+Disposi[cç][õo]es\s+Constitucionais\s+Transit[óo]rias")
AMENDMENT = Pattern(r"\bEC\s+|Emenda\s+Constitucional")


def is_transitional(text: Column) -> Column:
    """E17."""
    return TRANSITIONAL.found(text)


def is_amendment(text: Column) -> Column:
    """E17."""
    return AMENDMENT.found(text)
