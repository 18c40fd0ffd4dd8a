"""Driver queries of the detector families: numbers made from customer keys, judged by the catalogue and, in SQL, by arithmetic.

A template makes a text from the key's digits: # is the next digit, ~ a letter A to J for the next digit, anything else
stands for itself. Each row's text is read by the detectors of its family; what a detector confirms is a row of the
result. The SQL states each rule anew, as sums over the text's letters and digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.catalog import CATALOG
from veilframe.operators.detect import candidate_spans
from veilframe.sources.tables import table

DIGITS_SQL = "lpad(CAST((c_custkey * 982451653 + {salt} * 15485863) % 1000000000000000 AS VARCHAR), 15, '0') || lpad(CAST((c_custkey * 674506081 + {salt} * 32452843) % 1000000000 AS VARCHAR), 9, '0')"


def d(i: int) -> str:
    """The i-th letter or digit of a text, from 1, as a number."""
    return f"CAST(s[{i}] AS INT)"


def dot(weights, start: int = 1) -> str:
    return "(" + " + ".join(f"{w} * {d(start + i)}" for i, w in enumerate(weights)) + ")"


def n(a: int, b: int) -> str:
    return f"CAST(s[{a}:{b}] AS BIGINT)"


def down(first: int, last: int) -> range:
    return range(first, last - 1, -1)


def down_check(weights, check: int, ten: str = "0") -> str:
    """The check digit is 11 - sum mod 11, with 10 and 11 as `ten`."""
    r = f"(11 - {dot(weights)} % 11)"
    return f"(CASE WHEN {r} > 9 THEN {ten} ELSE {r} END) = {d(check)}"


def day(dd: tuple[int, int], mm: tuple[int, int]) -> str:
    return f"{n(*dd)} BETWEEN 1 AND 31 AND {n(*mm)} BETWEEN 1 AND 12"


def luhn(length: int, prefix: str = "") -> str:
    digits = [*prefix, *(f"s[{i}]" for i in range(1, length + 1))]
    terms = []
    for place, x in enumerate(reversed(digits)):
        v = f"CAST({x} AS INT)" if x.startswith("s[") else x
        terms.append(v if place % 2 == 0 else f"(CASE WHEN {v} > 4 THEN 2 * {v} - 9 ELSE 2 * {v} END)")
    return f"({' + '.join(terms)}) % 10 = 0"


VARIED = "length(replace(s, s[1], '')) > 0"
LETTER = "(ascii(s[{i}]) - 55)"

#: (detector, template, rule in SQL) by family; s has the letters and digits of the text.
FAMILIES: dict[str, list[tuple[str, str, str]]] = {
    "natid_west": [
        ("national-id-us-ssn", "###-##-####", "s[1:3] NOT IN ('000', '666') AND s[1] <> '9' AND s[4:5] <> '00' AND s[6:9] <> '0000'"),
        ("national-id-us-itin", "9##-##-####", f"{n(4, 5)} BETWEEN 70 AND 88 OR {n(4, 5)} BETWEEN 90 AND 92 OR {n(4, 5)} BETWEEN 94 AND 99"),
        ("national-id-ca-sin", "###-###-###", f"s[1] <> '8' AND {luhn(9)}"),
        ("national-id-gb-nhs", "### ### ####", f"(11 - {dot(down(10, 2))} % 11) % 11 = {d(10)}"),
        ("national-id-gb-nino", "AB ## ## ## C", "true"),
        ("national-id-ie-pps", "#######A", f"{dot(down(8, 2))} % 23 = 1"),
        ("national-id-es-dni", "########T", f"{n(1, 8)} % 23 = 0"),
        ("national-id-es-nie", "X#######T", f"{n(2, 8)} % 23 = 0"),
        ("national-id-nl-bsn", "#########", f"({dot(down(9, 2))} - {d(9)} + 99) % 11 = 0 AND {VARIED}"),
        ("national-id-be-rijksregister", "##.##.##-###.##", f"{n(10, 11)} IN (97 - {n(1, 9)} % 97, 97 - CAST('2' || s[1:9] AS BIGINT) % 97)"),
        ("national-id-pt-nif", "2########", down_check(down(9, 2), 9)),
        ("national-id-gr-afm", "#########", f"{dot([1 << k for k in down(8, 1)])} % 11 % 10 = {d(9)} AND {VARIED}"),
        ("national-id-us-ein", "12-#######", "true"),
    ],
    "natid_north_east": [
        ("national-id-se-personnummer", "##01##-####", f"{luhn(10)} AND {n(5, 6)} % 60 BETWEEN 1 AND 31"),
        ("national-id-dk-cpr", "####00-####", day((1, 2), (3, 4))),
        ("national-id-no-fodselsnummer", "###########", f"{dot((3, 7, 6, 1, 8, 9, 4, 5, 2, 1))} % 11 = 0 AND {dot((5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1))} % 11 = 0"),
        ("national-id-fi-hetu", "0101##-###A", f"CAST(s[1:6] || s[7:9] AS BIGINT) % 31 = 10"),
        ("national-id-is-kennitala", "0101##-####", down_check((3, 2, 7, 6, 5, 4, 3, 2), 9)),
        ("national-id-pl-pesel", "##0#0######", f"{VARIED} AND {dot((1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1))} % 10 = 0 AND {day((5, 6), (3, 4))}"),
        ("national-id-pl-nip", "###-###-##-##", f"{VARIED} AND {dot((6, 5, 7, 2, 3, 4, 5, 6, 7))} % 11 = {d(10)}"),
        ("national-id-pl-regon", "#########", f"{VARIED} AND {dot((8, 9, 2, 3, 4, 5, 6, 7))} % 11 % 10 = {d(9)}"),
        ("national-id-ro-cnp", "1##0101######", f"(CASE WHEN {dot((2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9))} % 11 = 10 THEN 1 ELSE {dot((2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9))} % 11 END) = {d(13)}"),
        ("national-id-bg-egn", "##0101####", f"{dot((2, 4, 8, 5, 10, 9, 7, 3, 6))} % 11 % 10 = {d(10)}"),
        ("national-id-si-emso", "0101#########", down_check((7, 6, 5, 4, 3, 2) * 2, 13)),
        ("national-id-cz-rodne-cislo", "##0101/####", f"{n(1, 10)} % 11 = 0"),
        ("national-id-ru-snils", "###-###-### ##", f"{dot(down(9, 1))} % 101 % 100 = {n(10, 11)}"),
        ("national-id-ua-rnokpp", "##########", f"({dot((-1, 5, 7, 9, 4, 6, 10, 5, 7))} + 99) % 11 % 10 = {d(10)}"),
        ("national-id-hu-szemelyi", "1##0101-####", f"{dot(range(1, 11))} % 11 = {d(11)}"),
    ],
    "natid_middle_east_asia": [
        ("national-id-tr-tckn", "1##########", f"(7 * ({' + '.join(d(i) for i in (1, 3, 5, 7, 9))}) - ({' + '.join(d(i) for i in (2, 4, 6, 8))}) + 100) % 10 = {d(10)} AND ({' + '.join(d(i) for i in range(1, 11))}) % 10 = {d(11)}"),
        ("national-id-il-teudat-zehut", "#########", f"{VARIED} AND {luhn(9)}"),
        ("national-id-sa", "1#########", luhn(10)),
        ("national-id-ae-emirates-id", "784-####-#######-#", luhn(15)),
        ("national-id-kw-civil-id", "2###########", f"11 - {dot((2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 3))} % 11 = {d(12)}"),
        ("national-id-qa-qid", "2##########", "true"),
        ("national-id-za", "##0101####0##", luhn(13)),
        ("national-id-kr-rrn", "##0101-1######", f"(11 - {dot((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5))} % 11) % 10 = {d(13)}"),
        ("national-id-jp-my-number", "#### #### ####", down_check((6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2), 12)),
        ("national-id-th", "1-####-#####-##-#", f"(11 - {dot(down(13, 2))} % 11) % 10 = {d(13)}"),
        ("national-id-in-pan", "ABC~A####K", "s[4] IN ('A', 'B', 'C', 'F', 'G', 'H', 'J')"),
        ("national-id-cn-ric", "11010119900101###X", f"({dot((7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2))} + 10) % 11 = 1"),
        ("national-id-pk-cnic", "1####-#######-#", "true"),
        ("national-id-my-mykad", "##0###-##-####", day((5, 6), (3, 4))),
        ("national-id-ph-psn", "####-####-####-####", "true"),
        ("national-id-vn-cccd", "0####0######", f"{n(1, 3)} BETWEEN 1 AND 96"),
        ("national-id-tw", "A1########", f"(1 + {dot(down(8, 1), 2)} + {d(10)}) % 10 = 0"),
    ],
    "natid_americas_oceania": [
        ("national-id-br-cpf", "###.###.###-##", f"{VARIED} AND {dot(down(10, 2))} * 10 % 11 % 10 = {d(10)} AND {dot(down(11, 2))} * 10 % 11 % 10 = {d(11)}"),
        ("national-id-ar-cuit", "##-########-#", f"(11 - {dot((5, 4, 3, 2, 7, 6, 5, 4, 3, 2))} % 11) % 11 = {d(11)}"),
        ("national-id-cl-rut", "1#######-#", f"(11 - {dot((3, 2, 7, 6, 5, 4, 3, 2))} % 11) % 11 = {d(9)}"),
        ("national-id-co-nit", "1########-#", f"(CASE WHEN {dot((41, 37, 29, 23, 19, 17, 13, 7, 3))} % 11 < 2 THEN {dot((41, 37, 29, 23, 19, 17, 13, 7, 3))} % 11 ELSE 11 - {dot((41, 37, 29, 23, 19, 17, 13, 7, 3))} % 11 END) = {d(10)}"),
        ("national-id-au-tfn", "### ### ###", f"{dot((1, 4, 3, 7, 5, 8, 6, 9, 10))} % 11 = 0"),
        ("national-id-au-abn", "5# ### ### ###", f"({dot((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19))} - 10) % 89 = 0"),
        ("national-id-au-medicare", "2### ##### #", f"{dot((1, 3, 7, 9, 1, 3, 7, 9))} % 10 = {d(9)}"),
        ("national-id-pe-dni", "DNI: ########", "true"),
        ("national-id-ar-dni", "DNI: ##.###.###", "true"),
        ("national-id-ng-nin", "NIN: ###########", "true"),
        ("national-id-ke", "ID No: ########", "true"),
        ("national-id-ma-cnie", "CIN: AB######", "true"),
        ("national-id-bd-nid", "1990#############", "true"),
        ("national-id-id-nik", "1#####0101##2###", f"{n(1, 2)} BETWEEN 11 AND 94"),
        ("national-id-mx-rfc", "ABCD##0101A##", "true"),
    ],
    "bank_codes": [
        ("us-routing-number", "#########", f"({n(1, 2)} BETWEEN 1 AND 12 OR {n(1, 2)} BETWEEN 21 AND 32 OR {n(1, 2)} BETWEEN 61 AND 72 OR s[1:2] = '80') AND {dot((3, 7, 1) * 3)} % 10 = 0"),
        ("au-bsb", "###-###", "true"),
        ("uk-sort-code", "##-##-##", "true"),
        ("in-ifsc", "ABCD0######", "true"),
        ("br-agencia", "Ag: ####-#", "true"),
        ("us-npi", "1#########", luhn(10, "80840")),
        ("credit-card", "4###############", luhn(16)),
    ],
    "vat_numbers": [
        ("eu-vat", "BE0#########", f"97 - {n(3, 10)} % 97 = {n(11, 12)}"),
        ("eu-vat", "DK########", f"{dot((2, 7, 6, 5, 4, 3, 2, 1), 3)} % 11 = 0"),
        ("eu-vat", "FI########", f"{dot((7, 9, 10, 5, 8, 4, 2), 3)} % 11 <> 1 AND (11 - {dot((7, 9, 10, 5, 8, 4, 2), 3)} % 11) % 11 = {d(10)}"),
        ("eu-vat", "PL##########", f"{dot((6, 5, 7, 2, 3, 4, 5, 6, 7), 3)} % 11 = {d(12)}"),
        ("eu-vat", "LU########", f"{n(3, 8)} % 89 = {n(9, 10)}"),
        ("eu-vat", "EL#########", f"{dot([1 << k for k in down(8, 1)], 3)} % 11 % 10 = {d(11)} AND s[3:11] <> '000000000'"),
        ("eu-vat", "EE#########", f"(10 - {dot((3, 7, 1, 3, 7, 1, 3, 7), 3)} % 10) % 10 = {d(11)}"),
        ("eu-vat", "HU########", f"(10 - {dot((9, 7, 3, 1, 9, 7, 3), 3)} % 10) % 10 = {d(10)}"),
        ("eu-vat", "MT########", f"37 - {dot((3, 4, 6, 7, 8, 9), 3)} % 37 = {n(9, 10)}"),
        ("eu-vat", "SK12########", f"{n(3, 12)} % 11 = 0 AND s[5] IN ('2', '3', '4', '7', '8', '9')"),
    ],
}


def text_sql(template: str) -> str:
    parts, at = [], 0
    for c in template:
        if c in "#~":
            at += 1
            parts.append(f"k[{at}]" if c == "#" else f"chr(65 + CAST(k[{at}] AS INT))")
        else:
            parts.append(f"'{c}'")
    return " || ".join(parts)


def text_of(template: str, digits: Column) -> Column:
    parts, at = [], 0
    for c in template:
        if c in "#~":
            at += 1
            one = F.substring(digits, at, 1)
            parts.append(one if c == "#" else F.char(F.lit(65) + one.cast("int")))
        else:
            parts.append(F.lit(c))
    return F.concat(*parts)


def family_sql(cases: list[tuple[str, str, str]]) -> str:
    parts = []
    for salt, (name, template, rule) in enumerate(cases):
        label = template[: template.index(": ") + 2] if ": " in template else ""
        made = f"SELECT c_custkey, {text_sql(template)} AS t FROM (SELECT c_custkey, {DIGITS_SQL.format(salt=salt)} AS k FROM customer)"
        own = f"SELECT c_custkey, t, regexp_replace(substr(t, {len(label) + 1}), '[^0-9A-Za-z]', '', 'g') AS s FROM ({made})"
        parts.append(f"SELECT c_custkey, '{name}' AS detector_id, t AS value FROM ({own}) WHERE {rule}")
    return " UNION ALL ".join(parts)


def family(spark: SparkSession, sf_dir: str, cases: list[tuple[str, str, str]]) -> DataFrame:
    """c_custkey, detector_id and value of the texts that their detector confirms."""
    key = F.col("c_custkey").cast("long")
    made = []
    for salt, (name, template, _) in enumerate(cases):
        digits = F.concat(F.lpad(((key * 982451653 + salt * 15485863) % 1000000000000000).cast("string"), 15, "0"), F.lpad(((key * 674506081 + salt * 32452843) % 1000000000).cast("string"), 9, "0"))
        made.append(F.struct(F.lit(name).alias("detector_id"), text_of(template, digits).alias("value")))
    rows = table(spark, sf_dir, "customer", spread=True).select("c_custkey", F.explode(F.array(*made)).alias("x")).select("c_custkey", "x.*")
    specs = [CATALOG[name] for name in dict.fromkeys(name for name, *_ in cases)]
    found = F.exists(candidate_spans(F.col("value"), specs=specs), lambda c: (c["detector_id"] == F.col("detector_id")) & (c["end"] == F.length("value")))
    return rows.where(found)


def family_query(cases: list[tuple[str, str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: family(spark, sf_dir, cases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: family_query(cases) for name, cases in FAMILIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: family_sql(cases) for name, cases in FAMILIES.items()}
