"""Document numbers, dates, status and applicants. Columns where Catalyst can say it; NFKC and casefold need Python."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import HYPHENS


def nfkc(col: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(run, "string")(col)


def publication_number(col: Column) -> Column:
    return F.regexp_replace(F.trim(nfkc(col)), f"[{HYPHENS}]", "-")


#: Kinds of numbers with two parts: pattern, key of a file, key to match by.
_KINDS = (("WO", "WO", "WO"), ("特開", "JP_A", "JP_A"), ("特表", "JP_AT", "JP_AT"), ("特開平", "JP_A_H", "JP_A_H"), ("特表平", "JP_AT_H", "JP_AT_H"))


def match_key(number: Column) -> Column:
    """PREFIX:year:number without leading zeros, or null, of a normalised number."""
    n = F.replace(F.replace(number, F.lit(" ")), F.lit("/"), F.lit("-"))
    out = F.lit(None).cast("string")
    for label, _, prefix in _KINDS:
        pattern = rf"^(?i){label}(\d{{4}})-(\d+)$" if "平" not in label else rf"^{label}(\d+)-(\d+)$"
        parts = [F.regexp_extract(n, pattern, k).try_cast("decimal(38,0)").cast("string") for k in (1, 2)]
        out = F.when(n.rlike(pattern), F.concat_ws(":", F.lit(prefix), *parts)).otherwise(out)
    registration = r"^特許第?(\d+)号$"
    return F.when(n.rlike(registration), F.concat(F.lit("JP_B:"), F.regexp_extract(n, registration, 1).try_cast("decimal(38,0)").cast("string"))).otherwise(out)


def file_key(stem: Column) -> Column:
    """Key of a file's stem: a canonical number, else an ASCII form with a digest where that loses something."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        name = unicodedata.normalize("NFKC", value).strip().translate({ord(c): "-" for c in HYPHENS})
        compact = name.replace(" ", "")
        for label, key, _ in _KINDS:
            era = label.endswith("平")
            if m := re.fullmatch(label + (r"(\d+)" if era else r"(\d{4})") + r"-(\d+)", compact, re.IGNORECASE):
                return f"{key}{int(m[1]):02d}_{m[2]}" if era else f"{key}_{m[1]}_{m[2]}"
        if m := re.fullmatch(r"特許第?(\d+)号", compact):
            return f"JP_B_{m[1]}"
        joined = re.sub(r"\s+", "_", name)
        plain = re.sub(r"[^A-Za-z0-9._-]+", "_", joined).strip("._-")
        if plain and plain == joined:
            return plain
        return f"{plain or 'PATENT'}_{hashlib.sha256(name.encode()).hexdigest()[:12]}"

    return F.udf(one, "string", useArrow=True)(stem)


def infer_year(number: Column) -> Column:
    """Heisei years 1 to 31 of applications; none for registrations; else the first 19xx or 20xx."""
    n = F.replace(number, F.lit(" "))
    era = F.regexp_extract(n, r"^(?:特開|特表)平(\d{1,2})-", 1)
    plain = F.nullif(F.regexp_extract(n, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")
    heisei = F.nullif(era, F.lit("")).try_cast("int")
    return F.when(era != "", F.when(heisei.between(1, 31), heisei + 1988)).when(n.rlike(r"^特許第?\d+号$") | F.upper(n).startswith("JPB"), F.lit(None).cast("int")).otherwise(plain)


def infer_status(number: Column) -> Column:
    n = F.upper(F.replace(number, F.lit(" ")))
    starts = lambda *ps: [n.startswith(p) for p in ps]
    registered, published = starts("JPB", "特許"), starts("JPA", "WO", "特開", "特表")
    return F.when(registered[0] | registered[1], "registered").when(published[0] | published[1] | published[2] | published[3], "published").otherwise("unknown")


def application_year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(date), r"^((?:19|20)\d{2})[./-]\d{1,2}[./-]\d{1,2}$", 1), F.lit("")).try_cast("int")


def document_year(date: Column, manifest: Column, number: Column) -> Column:
    """Application year, else the manifest's, else the number's; 0 counts as missing."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in (application_year(date), manifest, infer_year(number))])


def publications(numbers: Column, dates: Column) -> Column:
    """ARRAY<STRUCT<number, date, kind>> of two comma lists, paired by place."""
    parts = lambda c: F.filter(F.transform(F.split(c, ","), lambda v: F.trim(v)), lambda v: v != "")
    ds = parts(dates)
    return F.transform(
        parts(numbers), lambda n, i: F.struct(n.alias("number"), F.replace(F.get(ds, i), F.lit("."), F.lit("-")).alias("date"), F.when(F.upper(n).startswith("WO"), "wo").otherwise("domestic").alias("kind"))
    )


def organizations(applicant: Column) -> Column:
    """ARRAY<STRUCT<id, name>> of a cell of joint applicants, each once and in order."""

    def one(value: str | None) -> list[dict]:
        raw = unicodedata.normalize("NFKC", value or "").strip()
        if raw in ("", "未設定", "未調査"):
            return []
        names = dict.fromkeys(" ".join(part.split()) for part in re.split(r"[\r\n;；]", raw))
        return [{"id": "org_" + hashlib.sha256(n.casefold().encode()).hexdigest()[:16], "name": n} for n in names if n]

    return F.udf(one, "array<struct<id:string,name:string>>", useArrow=True)(applicant)


def clean_cell(col: Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(col, r"[\p{Cc}&&[^\t\r\n]]", "")
