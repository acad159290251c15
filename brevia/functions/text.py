"""Text functions as columns: normalising, tokens, abbreviations and synonyms (N1-N4, V8, V12, C7, FLT10)."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from brevia.functions.patterns import Pattern, any_of

#: White space and control characters that become one space; and of ASCII alone where more than a single space stands, since a
#: single space is no match and most of a text is passed over.
GAPS = r"[\x00-\x1F\x7F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000][\x00-\x20\x7F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*|\x20[\x00-\x20\x7F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
ASCII_GAPS = r"[\x00-\x1F\x7F][\x00-\x20\x7F]*|\x20[\x00-\x20\x7F]+"
#: The last letter of the blocks that most texts in Latin letters keep to.
LATIN = 0x24F


def folded(c: str) -> str:
    """A character with its compatibility form resolved, its marks removed, and case folded. The sign of degree is a letter."""
    if c == "°":
        return "o"
    return "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn").casefold()


class Folding:
    """From Unicode's own data, what every character folds to: `one` are those that become one character or none (`to`,
    shorter by the latter), `several` those that become more."""

    def __init__(self):
        found = {chr(k): x for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 and (x := folded(chr(k))) != chr(k) and not unicodedata.normalize("NFKC", chr(k)).isspace()}
        single, none = [c for c, x in found.items() if len(x) == 1], [c for c, x in found.items() if not x]
        self.one, self.to = "".join(single + none), "".join(found[c] for c in single)
        self.latin = "".join(c for c in single if ord(c) <= LATIN)
        self.latin_to = "".join(found[c] for c in self.latin)
        self.several = {c: x for c, x in found.items() if len(x) > 1}
        # pages of 256 characters, so that one is found by its number
        pages = [[None] * 256 if any(ord(c) >> 8 == p for c in self.several) else [] for p in range(max(ord(c) for c in self.several) // 256 + 1)]
        for c, x in self.several.items():
            pages[ord(c) >> 8][ord(c) & 255] = x
        self.pages = json.dumps(pages)
        # some marks have no class of their own, but resolve to marks that have
        marks = [chr(k) for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000 and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", chr(k)))]
        self.marks = "".join(marks)
        #: Marks that stay, by their class: within a run of marks they stand in the order of their classes.
        self.stay = {n: "".join(c for c in marks if c not in self.one and unicodedata.combining(c) == n) for n in sorted({unicodedata.combining(c) for c in marks if c not in self.one})}


@functools.cache
def folding() -> Folding:
    """Made when it is first asked for: workers that import this module don't need it."""
    return Folding()


def _spread(text: Column) -> Column:
    """The text with characters that become several replaced."""
    pages = F.from_json(F.lit(folding().pages), "array<array<string>>")  # a constant

    def of(c: Column) -> Column:
        code = F.ascii(c)
        return F.coalesce(F.get(F.get(pages, F.shiftright(code, 8)), code.bitwiseAND(F.lit(255))), c)

    found = F.array_join(F.transform(F.split(text, ""), of), "")
    return F.when(F.length(F.translate(text, "".join(folding().several), "")) < F.length(text), found).otherwise(text)


def _ordered(text: Column) -> Column:
    """The text with marks that stay in the order of their classes. All others of a run of marks, which go anyway, do."""
    every, stay = "".join(folding().stay.values()), folding().stay
    run = f"[{folding().marks}]{{2,}}"
    by_class = lambda r: F.concat(*[F.regexp_replace(r, f"[^{own}]", "") for own in stay.values()])
    runs = F.concat(F.transform(F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1)), by_class), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(text, run), runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.length(F.translate(text, every, "")) < F.length(text), joined).otherwise(text)  # hardly ever


def _ways(text: Column, short, rest) -> Column:
    """Of a text the letters of fold(): short(x) of a text of ASCII alone, rest(x) of others."""
    t = F.coalesce(text, F.lit(""))
    few = "".join(c for c in folding().several if ord(c) <= LATIN)
    latin = rest(F.translate(t, folding().latin, folding().latin_to))
    spread = F.get(F.transform(F.array(_spread(t)), _ordered), F.lit(0))  # spread once, though it is named several times
    whole = rest(F.translate(spread, folding().one, folding().to))
    return F.when(F.octet_length(t) == F.length(t), short(F.lower(t))).when(~t.rlike(f"[^\\x00-{chr(LATIN)}]|[{few}]"), latin).otherwise(whole)


def fold(text: Column) -> Column:
    """The last steps of N3: compatibility forms resolved, marks removed, case folded (as NFKC, NFD and case folding of the whole
    of Unicode), the sign of degree as o, white space collapsed, trimmed. Null is empty. Texts of ASCII alone, and of Latin
    letters alone, take short ways."""
    spaced = lambda gaps: lambda x: F.trim(F.regexp_replace(x, gaps, " "))
    return _ways(text, spaced(ASCII_GAPS), spaced(GAPS))


def fold_letters(text: Column) -> Column:
    """fold() with its white space left as it is, for what looks at letters and digits alone."""
    return _ways(text, lambda x: x, lambda x: x)


#: Wrongly decoded letters and what they were, in order.
MOJIBAKE = (
    ("Ã§", "ç"), ("Ã£", "ã"), ("Ãµ", "õ"), ("Ã¡", "á"), ("Ã©", "é"), ("Ã\xad", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã¢", "â"), ("Ãª", "ê"), ("Ã´", "ô"), ("Ã\xa0", "à"),
    ("Ã\x81", "Á"), ("Ã‰", "É"), ("â€œ", '"'), ("â€ ", '"'), ("â€˜", "'"), ("â€™", "'"),
)


def repaired(text: Column) -> Column:
    """N1."""
    out = text
    for wrong, right in MOJIBAKE:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.when(text.rlike("Ã|â€"), out).otherwise(text)


#: Legal abbreviations.
ABBREVIATIONS = {
    "CP": "Código Penal", "CPP": "Código de Processo Penal", "CT": "Código Tributário", "CTN": "Código Tributário Nacional", "CDC": "Código de Defesa do Consumidor",
    "CLT": "Consolidação das Leis do Trabalho", "CF/88": "Constituição Federal de 1988", "CF": "Constituição Federal", "CB": "Código Brasileiro", "CBo": "Código Civil", "CC": "Código Civil",
    "STF": "Supremo Tribunal Federal", "STJ": "Superior Tribunal de Justiça", "STM": "Superior Tribunal Militar", "TSE": "Tribunal Superior Eleitoral", "TST": "Tribunal Superior do Trabalho",
    "TCU": "Tribunal de Contas da União", "TRF": "Tribunal Regional Federal", "TRT": "Tribunal Regional do Trabalho", "TRE": "Tribunal Regional Eleitoral",
    "TCE": "Tribunal de Contas do Estado", "TCM": "Tribunal de Contas do Município", "RTF": "Recurso de Extraordinário Federal", "RE": "Recurso Extraordinário", "REsp": "Recurso Especial",
    "RExt": "Recurso Extraordinário", "AI": "Agravo de Instrumento", "AR": "Agravo Regimental", "AG": "Agravo", "ED": "Embargos de Declaração", "EI": "Embargos Infringentes",
    "EN": "Embargos de Divergência", "ADI": "Ação Direta de Inconstitucionalidade", "ADC": "Ação Declaratória de Constitucionalidade",
    "ADPF": "Arguição de Descumprimento de Preceito Fundamental", "MI": "Mandado de Injunção", "HC": "Habeas Corpus", "HD": "Habeas Data", "MS": "Mandado de Segurança",
    "RHC": "Recurso em Habeas Corpus", "RMS": "Recurso em Mandado de Segurança", "RMI": "Recurso em Mandado de Injunção", "AC": "Ação Civil", "AP": "Ação Penal", "APn": "Ação Penal",
    "RCL": "Reclamação", "PET": "Petição", "SL": "Súmula Vinculante", "SV": "Súmula Vinculante",
}
#: Terms of queries and the law or term that they stand for.
SYNONYMS = {
    "lia": "Lei 8.429/1992", "lei de improbidade": "Lei 8.429/1992", "improbidade administrativa": "Lei 8.429/1992", "lei anti-corrupcao": "Lei 8.429/1992", "lei anticorrupcao": "Lei 8.429/1992",
    "acao de improbidade": "Lei 8.429/1992", "nova lei de licitacoes": "Lei 14.133/2021", "lei de licitacoes nova": "Lei 14.133/2021", "lei de licitações nova": "Lei 14.133/2021",
    "lei 14133": "Lei 14.133/2021", "estatuto da licitacao": "Lei 14.133/2021", "estatuto da licitação": "Lei 14.133/2021", "lei de licitacoes": "Lei 14.133/2021",
    "lei de licitacoes antiga": "Lei 8.666/1993", "lei 8666": "Lei 8.666/1993", "codigo civil": "Lei 10.406/2002", "código civil": "Lei 10.406/2002", "cc": "Código Civil", "cod civil": "Código Civil",
    "codigo penal": "Decreto-Lei 2.848/1940", "código penal": "Decreto-Lei 2.848/1940", "cp": "Código Penal", "cod penal": "Código Penal", "lei penal": "Decreto-Lei 2.848/1940",
    "codigo processo penal": "Decreto-Lei 3.689/1941", "código de processo penal": "Decreto-Lei 3.689/1941", "cpp": "Código de Processo Penal", "clt": "Consolidação das Leis do Trabalho",
    "consolidacao das leis do trabalho": "Decreto-Lei 5.452/1943", "constituicao federal": "Constituição Federal de 1988", "constituição federal": "Constituição Federal de 1988",
    "cf": "Constituição Federal de 1988", "cf/88": "Constituição Federal de 1988", "cf88": "Constituição Federal de 1988", "constituicao de 1988": "Constituição Federal de 1988",
    "constituição de 88": "Constituição Federal de 1988", "constituinte": "Constituição Federal de 1988", "cdc": "Código de Defesa do Consumidor", "codigo defesa consumidor": "Lei 8.078/1990",
    "lei do consumidor": "Lei 8.078/1990", "codigo de defesa do consumidor": "Lei 8.078/1990", "codigo tributario": "Lei 5.172/1966", "código tributário": "Lei 5.172/1966",
    "ctn": "Código Tributário Nacional", "lei 5172": "Lei 5.172/1966", "licc": "Lei de Introdução às Normas do Direito Brasileiro", "lintro": "Lei de Introdução às Normas do Direito Brasileiro",
    "lei de introducao": "Lei de Introdução às Normas do Direito Brasileiro", "lei de introdução": "Lei de Introdução às Normas do Direito Brasileiro",
    "lin": "Lei de Introdução às Normas do Direito Brasileiro", "linb": "Lei de Introdução às Normas do Direito Brasileiro", "linbd": "Lei de Introdução às Normas do Direito Brasileiro",
    "lindeb": "Lei de Introdução às Normas do Direito Brasileiro", "estatuto do idoso": "Lei 10.741/2003", "lei do idoso": "Lei 10.741/2003", "eca": "Estatuto da Criança e do Adolescente",
    "estatuto da crianca": "Lei 8.069/1990", "estatuto da criança e adolescente": "Lei 8.069/1990", "lei 8069": "Lei 8.069/1990", "lei maria da penha": "Lei 11.340/2006",
    "maria da penha": "Lei 11.340/2006", "lei da mulher": "Lei 11.340/2006", "lei 11340": "Lei 11.340/2006", "lei seca": "Lei 11.705/2008", "lei 11705": "Lei 11.705/2008",
    "lei seca transito": "Lei 11.705/2008", "ficha limpa": "Lei Complementar 135/2010", "lei ficha limpa": "Lei Complementar 135/2010", "lc 135": "Lei Complementar 135/2010",
    "lgpd": "Lei Geral de Proteção de Dados", "lei de protecao de dados": "Lei 13.709/2018", "lei de proteção de dados": "Lei 13.709/2018", "lei 13709": "Lei 13.709/2018",
    "prescricao": "prescrição", "prescriçao": "prescrição", "decadencia": "decadência", "decadencia civil": "decadência civil", "atos civis": "atos jurídicos", "fatos civis": "fatos jurídicos",
    "crime hediondo": "crimes hediondos", "crime contra a administracao publica": "crimes contra a administração pública", "crime contra a administracao": "crimes contra a administração pública",
    "crime contra o patrimonio": "crimes contra o patrimônio", "furto qualificado": "furto qualificado", "roubo circunstanciado": "roubo circunstanciado",
    "remedio constitucional": "remédios constitucionais", "acao constitucional": "ações constitucionais", "clausulas petreas": "cláusulas pétreas", "clausulas ptreas": "cláusulas pétreas",
    "ato administrativo": "atos administrativos", "licitacao": "licitação", "contrato administrativo": "contratos administrativos", "concurso publico": "concurso público",
    "servidor publico": "servidor público", "statu": "estatuto", "estatu": "estatuto",
}


def longest_first(table: dict[str, str]) -> list[tuple[str, str]]:
    """Longer terms before shorter ones, terms of one length as they stand."""
    return sorted(table.items(), key=lambda x: -len(x[0]))


def word_pattern(term: str) -> Pattern:
    """A term between word boundaries, in any case; / and - stand for themselves."""
    return Pattern(rf"\b{term}\b")


def expanded(text: Column) -> Column:
    """Abbreviations written out, the longest first."""
    for short, long in longest_first(ABBREVIATIONS):
        text = word_pattern(short).replaced(text, long)
    return text


def normalised(text: Column) -> Column:
    """N3 in full: N2, N1, then fold()."""
    return fold(repaired(expanded(F.coalesce(text, F.lit("")))))


def rewritten(text: Column) -> Column:
    """struct<now: the text with synonyms replaced, found: array<struct<term, target, count>>>. One fold over the table,
    the longest terms first, so that each step sees what the steps before have left."""
    table = F.array(*[F.struct(F.lit(word_pattern(t).java).alias("p"), F.lit(t).alias("term"), F.lit(to).alias("target")) for t, to in longest_first(SYNONYMS)])
    kind = "struct<now:string,found:array<struct<term:string,target:string,count:int>>>"
    start = F.struct(F.coalesce(text, F.lit("")).alias("now"), F.array().alias("found")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        n = F.regexp_count(s["now"], x["p"])
        told = F.array(F.struct(x["term"].alias("term"), x["target"].alias("target"), n.alias("count")))
        return F.when(n == 0, s).otherwise(F.struct(F.regexp_replace(s["now"], x["p"], x["target"]).alias("now"), F.concat(s["found"], told).alias("found")).cast(kind))

    return F.aggregate(table, start, step)


def terms(text: Column) -> Column:
    """V8: ASCII terms of three characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 3)


#: Words that are no tokens.
STOP_WORDS = ("a", "ao", "aos", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "na", "nas", "no", "nos", "o", "os", "ou", "para", "por", "que", "se", "um", "uma")


def tokens(text: Column) -> Column:
    """V12, of a text that is normalised but for fold(): words of two characters or more, without stop words."""
    return tokens_of_folded(fold(text))


def tokens_of_folded(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9à-ÿ]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def lexical_units(text: Column) -> Column:
    """Number of word runs and single other signs."""
    return units_of_folded(fold(text))


def units_of_folded(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[a-z0-9_]+|[^a-z0-9_\x20]"))


#: What a query says about an article or a law, and words that tell the kind of source.
QUERY_ARTICLE = Pattern(r"\bart(?:igo)?\.?\s*(\d+(?:-[a-z])?)\b")
QUERY_LAW = Pattern(r"\blei\s*(?:n[º°o]\.?\s*)?(\d{1,5}(?:\.\d{3})?)(?:/(\d{2,4}))?\b")
QUERY_KINDS = (
    (("jurisprudencia", "sumula", "acordao"), "jurisprudence", "jurisprudence"),
    (("concurso", "questao", "prova"), "exam_question", "exam_question"),
    (("doutrina", "manual", "comentario"), "doctrine", "commentary"),
    (("artigo", "lei", "caput", "inciso"), "legal_text", "lei_cf"),
)


def query_filters(text: Column) -> Column:
    """FLT10: map of filters that a normalised query asks for; what it doesn't ask for is missing."""
    has = lambda *words: any_of([Pattern(w, "") for w in words], text)
    law = F.concat_ws("/", F.replace(QUERY_LAW.first(text), F.lit("."), F.lit("")), QUERY_LAW.first(text, 2))
    content = source = F.lit(None).cast("string")
    for words, c, s in reversed(QUERY_KINDS):
        content, source = F.when(has(*words), c).otherwise(content), F.when(has(*words), s).otherwise(source)
    yes = lambda c: F.when(c, "true")
    asked = {
        "artigo": F.upper(QUERY_ARTICLE.first(text)), "law_number": F.nullif(law, F.lit("")), "marca_stf": yes(has("stf", "supremo tribunal federal")),
        "marca_stj": yes(has("stj", "superior tribunal de justica")), "content_type": content, "source_type": source, "is_exam_focus": yes(content == "exam_question"),
    }
    return F.map_filter(F.create_map(*[x for k, c in asked.items() for x in (F.lit(k), c)]), lambda k, v: v.isNotNull())
