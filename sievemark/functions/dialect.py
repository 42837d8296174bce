"""Spelling of a few scalar functions in Spark SQL and in the checking engine's SQL.

Expressions are written once over these and rendered for either; patterns keep to what both regex engines share.
"""

from __future__ import annotations

import re as _re


class Spark:
    name = "spark"

    @staticmethod
    def lit(p: str) -> str:
        if "'" in p:  # a raw literal can't hold the quote that ends it
            return "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"r'{p}'" if "\\" in p else f"'{p}'"

    @classmethod
    def has(cls, x: str, p: str) -> str:
        return f"({x} RLIKE {cls.lit(p)})"

    @classmethod
    def sub(cls, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {cls.lit(p)}, '{by}')"

    @classmethod
    def first(cls, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {cls.lit(p)}, {group})"

    @classmethod
    def count(cls, x: str, p: str) -> str:
        return f"CAST(regexp_count({x}, {cls.lit(p)}) AS BIGINT)"

    @staticmethod
    def num(x: str) -> str:
        return f"TRY_CAST({x} AS BIGINT)"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha2({x}, 256)"

    @staticmethod
    def hexed(b64: str) -> str:
        return f"hex(unbase64({b64}))"

    @staticmethod
    def bytes(x: str) -> str:
        return f"CAST(octet_length({x}) AS BIGINT)"

    @staticmethod
    def date(y: str, m: str, d: str) -> str:
        return f"(try_to_date({y} || '-' || {m} || '-' || {d}, 'yyyy-MM-dd') IS NOT NULL)"

    @staticmethod
    def ends(x: str, y: str) -> str:
        return f"endswith({x}, {y})"

    @staticmethod
    def hex(x: str) -> str:
        return f"hex({x})"

    @staticmethod
    def js(x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def lit(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    @classmethod
    def has(cls, x: str, p: str) -> str:
        return f"regexp_matches({x}, {cls.lit(p)})"

    @classmethod
    def sub(cls, x: str, p: str, by: str) -> str:
        return f"regexp_replace({x}, {cls.lit(p)}, '{_re.sub(r'[$]([0-9])', r'\\\1', by)}', 'g')"

    @classmethod
    def count(cls, x: str, p: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {cls.lit(p)})) AS BIGINT)"

    @staticmethod
    def sha(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def hexed(b64: str) -> str:
        return f"hex(from_base64({b64}))"

    @staticmethod
    def bytes(x: str) -> str:
        return f"CAST(strlen({x}) AS BIGINT)"

    @staticmethod
    def date(y: str, m: str, d: str) -> str:
        return f"(TRY_CAST({y} || '-' || {m} || '-' || {d} AS DATE) IS NOT NULL)"

    @staticmethod
    def ends(x: str, y: str) -> str:
        return f"ends_with({x}, {y})"

    @staticmethod
    def js(x: str, path: str) -> str:
        return f"({x} ->> '$.{path}')"
