"""Text normalisation, classification and display, all as built-in column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(accented, plain): every character whose decomposition leaves exactly one ASCII character."""
    accented, plain = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        left = [c for c in unicodedata.normalize("NFD", chr(code)) if ord(c) < 0x80]
        if len(left) == 1:
            accented.append(chr(code))
            plain.append(left[0])
    return "".join(accented), "".join(plain)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_accents(col: Column) -> Column:
    """Accents removed, then everything outside ASCII dropped."""
    accented, plain = accent_table()
    return F.regexp_replace(F.translate(col, accented, plain), r"[^\x00-\x7F]", "")


def fold_text(col: Column) -> Column:
    """Accent-free, lower case, single spaces, trimmed; null becomes the empty string."""
    lowered = F.lower(strip_accents(col.cast("string")))
    return F.coalesce(F.trim(F.regexp_replace(lowered, r"[\s\x1c-\x1f]+", " ")), F.lit(""))


def fold_label(col: Column) -> Column:
    """Like ``fold_text`` but inner whitespace is kept, as used when comparing ingest labels."""
    return F.coalesce(F.btrim(F.lower(strip_accents(col.cast("string"))), F.lit(" \t\n\r")), F.lit(""))


# Property classes in the order they are tested. A class is chosen when the folded
# text contains one of the parts or equals one of the words.
KIND_RULES = (
    ("Lançamento", ("lanc",), ()),
    ("Comercial", ("comercial", "sala/"), ("sala",)),
    ("Studio", ("studio", "loft", "flat"), ()),
    ("Cobertura", ("cobert", "penthouse"), ()),
    ("Apartamento", ("apart",), ()),
    ("Casa", ("sobrado", "geminad", "casa"), ()),
    ("Terreno", ("terreno", "lote"), ()),
    ("Chácara", ("chacara", "sitio", "area de terra", "area rural"), ("area",)),
    ("Prédio", ("predio",), ()),
)
# The narrow variant does not know "area de terra".
KIND_RULES_NARROW = tuple(
    ("Chácara", ("chacara", "sitio", "area rural"), ("area",)) if name == "Chácara" else (name, parts, words)
    for name, parts, words in KIND_RULES
)
OTHER_KIND = "Outros"


def canonical_kind(col: Column, rules=KIND_RULES) -> Column:
    """First matching property class; empty stays empty, no match is ``Outros``."""

    def classify(text: Column) -> Column:
        out = F.when(text == "", F.lit(""))
        for name, parts, words in rules:
            tests = [text.contains(part) for part in parts] + [text == word for word in words]
            hit = tests[0]
            for test in tests[1:]:
                hit = hit | test
            out = out.when(hit, F.lit(name))
        return out.otherwise(F.lit(OTHER_KIND))

    return once(fold_text(col), classify)


# Alternative spellings of a district, keyed by folded text.
DISTRICT_ALIASES = {"presidente medice": "Presidente Medici"}


def unify_district(col: Column, aliases: dict[str, str] = DISTRICT_ALIASES) -> Column:
    """Replace a known alternative spelling by the official name, keep anything else as it is."""
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[fold_text(col)], col) if pairs else col


def canonical_district(col: Column) -> Column:
    """Folded district, or a placeholder when there is none."""
    text = fold_text(col)
    return F.when(text == "", F.lit("sem bairro")).otherwise(text)


ADDRESS_EDGE = " ,-/"
# An address is cut from the first of these words on.
ADDRESS_STOP_WORDS = ("cep", "chapeco", "sc")


def canonical_address(col: Column, street_only: bool = False, stop_words=ADDRESS_STOP_WORDS) -> Column:
    """Folded address without its city/postcode tail, optionally only the street."""
    text = fold_text(col)
    for word in stop_words:
        text = F.regexp_replace(text, rf"\b{word}\b.*$", "")
    text = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(ADDRESS_EDGE))
    if street_only:
        text = F.split(text, r"\s*,\s*", 2)[0]
        text = F.split(text, r"\s+-\s+", 2)[0]
    return F.btrim(text, F.lit(ADDRESS_EDGE))


def source_prefix(col: Column) -> Column:
    """Text before the first hyphen, empty without one."""
    return F.when(col.contains("-"), F.substring_index(col, "-", 1)).otherwise(F.lit(""))


def listing_code(code: Column, identifier: Column) -> Column:
    """The explicit code, else the identifier with its source prefix, else empty."""
    filled = F.coalesce(F.nullif(code.cast("string"), F.lit("")), F.nullif(identifier.cast("string"), F.lit("")))
    return F.coalesce(F.trim(filled), F.lit(""))


def format_address(street: Column, number: Column, extra: Column) -> Column:
    """``street, number - extra`` without blank or placeholder parts; null without a street."""

    def clean(part: Column) -> Column:
        text = F.trim(F.regexp_replace(F.coalesce(part.cast("string"), F.lit("")), r"\s+", " "))
        return F.when(text.rlike(r"^[*#xX./ ]*$"), F.lit("")).otherwise(text)

    street, number, extra = clean(street), clean(number), clean(extra)
    tail = F.concat(
        F.when(number != "", F.concat(F.lit(", "), number)).otherwise(F.lit("")),
        F.when(extra != "", F.concat(F.lit(" - "), extra)).otherwise(F.lit("")),
    )
    return F.when(street != "", F.concat(street, tail))


def slug_title(col: Column, prefix: str = "") -> Column:
    """``bairro-sao-lucas`` with prefix ``bairro-`` gives ``Sao Lucas``."""
    text = F.regexp_replace(col, f"^{prefix}", "") if prefix else col
    return F.initcap(F.translate(text, "-", " "))


def district_label(col: Column) -> Column:
    """Display name of a district with a marker for the empty one."""
    return F.coalesce(F.initcap(F.nullif(F.trim(col), F.lit(""))), F.lit("(sem bairro)"))


def format_currency(col: Column) -> Column:
    """``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(col, 2), ",.", ".,"))


def format_percent(col: Column, digits: int = 2) -> Column:
    """Signed percentage with a decimal comma, e.g. ``+4,96%``."""
    body = F.translate(F.format_number(F.abs(col), digits), ",.", ".,")
    return F.concat(F.when(col < 0, F.lit("-")).otherwise(F.lit("+")), body, F.lit("%"))


# Month abbreviations of the display format.
MONTH_NAMES = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def format_month(col: Column) -> Column:
    """``out/2016``."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.concat(F.element_at(names, F.month(col)), F.lit("/"), F.year(col).cast("string"))


# Class names, descriptions and aliases of the published catalogue.
KIND_CATALOG = (
    ("Apartamento", "Unidades residenciais em edifícios, incluindo duplex.", ("apartamento", "apart", "apto", "apartamento duplex", "duplex")),
    ("Casa", "Casas, geminadas e sobrados.", ("casa", "casa geminada", "geminada", "sobrado")),
    (
        "Terreno",
        "Terrenos, lotes e áreas de terra/rurais.",
        (
            "terreno", "lote", "lote urbano", "terreno urbano", "terreno em condomínio", "area", "área", "area de terra",
            "área de terra", "area rural", "área rural", "lote rural", "loteamento",
        ),
    ),
    ("Cobertura", "Coberturas e penthouses.", ("cobertura", "penthouse")),
    ("Chácara", "Chácaras e sítios.", ("chacara", "chácara", "sitio", "sítio", "chácara / sítio", "chacara / sitio")),
    (
        "Prédio",
        "Prédios e edifícios inteiros.",
        ("predio", "prédio", "predios", "prédios", "predio residencial", "prédio residencial", "predio comercial", "prédio comercial"),
    ),
    ("Studio", "Studios e apartamentos compactos.", ("studio", "studios", "apartamento studio", "apartamentos studio", "flat", "loft")),
    ("Comercial", "Imóveis com uso comercial.", ("comercial", "sala comercial", "sala", "sala/conjunto", "casa comercial")),
    ("Lançamento", "Imóveis em lançamento ou pré-lançamento.", ("lancamento", "lançamento", "lancamentos", "lançamentos")),
    ("Outros", "Fallback para tipos sem similaridade suficiente.", ()),
)
