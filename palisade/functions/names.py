"""Identifier and literal normalisation, as Python helpers and as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column types that count as numeric; all else is text or other.  Fixed values.
NUMERIC_TYPES = ("integer", "real", "float", "double", "numeric", "number", "decimal")
_SPARK_NUMERIC = r"^(int|bigint|smallint|tinyint|long|short|byte|float|double|decimal|real|numeric|number|integer)"


def norm(name: str | None) -> str:
    """Stripped, one level of quotes off, lower case."""
    s = (name or "").strip()
    if len(s) >= 2 and (s[0], s[-1]) in {('"', '"'), ("'", "'"), ("`", "`"), ("[", "]")}:
        s = s[1:-1]
    return s.strip().lower()


def norm_col(c: Column) -> Column:
    inner = F.regexp_replace(F.trim(c), r"""^(?:"(.*)"|'(.*)'|`(.*)`|\[(.*)\])$""", "$1$2$3$4")
    return F.lower(F.trim(inner))


def is_numeric_type(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike(_SPARK_NUMERIC)


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def alias_name(name: str) -> str:
    """Letters, digits and underscores only, not starting with a digit."""
    s = re.sub(r"_+", "_", re.sub(r"\W", "_", name)).strip("_") or "col"
    return "_" + s if s[0].isdigit() else s


#: Tokens of column names that stay as they are, and words that say nothing.  Fixed values.
KEPT = frozenset("id ids dob uuid uid ssn ip frpm nslp nces calpads iga igg igm ana lac crp ssa ssb soc rf ua tp glu hgb ldh gpt alp cds rbc wbc rvvt kct".split())
DROPPED = frozenset("the a an of and or to for".split())
#: Endings that look like plurals and are none.  Fixed values.
SINGULAR_ENDINGS = ("osis", "itis", "sis", "us", "as", "is")


def fold(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _camel(text: str) -> str:
    """Blanks where a word begins within a word: before a capital that follows a small letter or digit, and before the last of several capitals."""
    out = []
    for i, c in enumerate(text):
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c.isupper() and ((before.islower() or before.isdigit()) and (after.islower() or after.isupper()) or before.isupper() and after.islower()):
            out.append(" ")
        out.append(c)
    return "".join(out)


def singular(word: str) -> str:
    """Conservative singular of a lower-case word."""
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ches", "shes", "xes", "sses", "zzes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def column_phrase(name: str | None) -> str:
    """Lower-case words of a column's name, plurals made singular; codes, roman numerals and common abbreviations stay."""
    text = re.sub(r"[_/.,:;()\[\]{}%*-]+", " ", fold(name or ""))
    out = []
    for raw in re.findall(r"[A-Za-z]+[0-9]+|[0-9]+|[A-Za-z]+", _camel(text)):
        word = raw.lower()
        if word in DROPPED:
            continue
        code = any(c.isalpha() for c in raw) and any(c.isdigit() for c in raw) or raw.isupper() and 2 <= len(raw) <= 10
        plural = word.isalpha() and len(word) >= 5 and not word.endswith(SINGULAR_ENDINGS)
        out.append(singular(word) if plural and not code and word not in KEPT and not set(word) <= set("ivxlcdm") else word)
    joined = re.sub(r"\bi d\b", "id", " ".join(out))
    return re.sub(r"\b([a-z]) (\d+)\b", r"\1\2", joined)


def table_phrase(name: str | None) -> str:
    """Lower-case words of a table's name, each in the singular."""
    text = re.sub(r"[_-]+", " ", fold(name or ""))
    words = re.findall(r"[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+|[0-9]+|[A-Za-z]+", _camel(text))
    out = [singular(w.lower()) if w.isalpha() and len(w) >= 3 and w.lower() not in ("frpm", "zip", "zipcode") and not w.lower().endswith(SINGULAR_ENDINGS) else w.lower() for w in words]
    return " ".join(out).replace("zipcode", "zip code")


@F.pandas_udf(T.StringType())
def column_phrase_of(names: pd.Series) -> pd.Series:
    return names.map(column_phrase)


@F.pandas_udf(T.StringType())
def table_phrase_of(names: pd.Series) -> pd.Series:
    return names.map(table_phrase)
