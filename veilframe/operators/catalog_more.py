"""More detectors: VAT numbers, places, licences, generic secrets, Monero, and further national and tax ids."""

from __future__ import annotations

import math
import re
from collections import Counter

from veilframe.functions.checks import hybrid_11_10, icao, luhn, numeric, weigh
from veilframe.functions.keccak import keccak256
from veilframe.operators.catalog import B58, DIGIT, DNI, GLOBAL, HIGH, LOW, MEDIUM, N, T, Verdict, apart, coin, complement11, day, detector, number


def two_phase(s: str, first, second, n: int) -> bool:
    """mod 11 with a second set of weights where the first leaves 10; a second 10 is never issued."""
    r = weigh(s[:n], first) % 11
    return (weigh(s[:n], second) % 11 if r == 10 else r) == int(s[n])


def folded(s: str, doubled: int) -> int:
    """Digit sum with every second digit doubled, the first one at index doubled."""
    return sum(int(c) if i % 2 != doubled else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(s))


# bank codes
# Institution numbers.
INSTITUTIONS = set("001 002 003 004 006 010 016 030 039 117 127 177 219 241 245 260 265 269 270 290 308 309 326 338 340 509 540 568 614 621 623 618 809 815 819 828 829 837 839 849 865 879 889 899".split())
number("ca-transit-number", "CA_TRANSIT_NUMBER", "CA", r"\b\d{5}-\d{3}\b", lambda s, m: s[5:] in INSTITUTIONS, "transit-institution-table", MEDIUM)

# wallets
SIZES = [0, 2, 3, 5, 6, 7, 9, 10, 11]


def monero(s: str) -> bool:
    """Base58 by blocks of 11 characters for 8 bytes; the last 4 bytes are a Keccak checksum."""
    raw = b""
    for at in range(0, len(s), 11):
        block, value = s[at : at + 11], 0
        if len(block) not in SIZES:
            return False
        for c in block:
            value = value * 58 + B58.index(c)
        size = SIZES.index(len(block))
        if value >= 256**size:
            return False
        raw += value.to_bytes(size, "big")
    return raw[0] in (0x12, 0x2A, 0x13) and len(raw) in (69, 77) and keccak256(raw[:-4])[:4] == raw[-4:]


coin("crypto-xmr", r"\b[48][1-9A-HJ-NP-Za-km-z]{94}(?:[1-9A-HJ-NP-Za-km-z]{11})?\b", monero, "monero-keccak")


@detector("crypto-eth", "CRYPTO_WALLET", GLOBAL, r"\b0x[0-9a-fA-F]{40}\b", HIGH, hint="0x")
def ethereum(m):
    """Mixed case carries a checksum; one case has none. The zero address is nobody's."""
    body = m[0][2:]
    low = body.lower()
    meta = {"chain": "eth"}
    if body in (low, body.upper()):
        return Verdict(MEDIUM, f"0x{low}", int(low, 16) > 0, "eth-structural", metadata=meta)
    digest = keccak256(low.encode()).hex()
    ok = all(c == (c.upper() if int(h, 16) > 7 else c.lower()) for c, h in zip(body, digest))
    return Verdict(HIGH, m[0], True, "eip55", metadata=meta) if ok else None


# licences
US_LICENCES = {7: "CA", 11: "IL", 12: "FL", 14: "NJ", 18: "NY"}


@detector("drivers-license", "DRIVERS_LICENSE", "GB US", r"\b(?:[A-Z9]{5}\d{6}[A-Z9]{2}\d[A-Z]{2}|[A-Za-z]\d{7}(?:\d{4,11})?)\b", MEDIUM, hint=DIGIT)
def licence(m):
    s = m[0].upper()
    if s[1:].isdigit():
        state = US_LICENCES.get(len(s) - 1)
        return Verdict(LOW, s, True, "state-shape", metadata={"jurisdiction": "US", "state": state}) if state else None
    month = int(s[6:8])
    return Verdict(MEDIUM, s, True, "dvla-structure", metadata={"jurisdiction": "GB"}) if day(s[8:10], month - 50 * (month > 50)) else None


# places
# Postal formats by country; countries with plain digits are grouped by their number.
POSTAL = {
    "GB": r"GIR ?0AA|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}", "CA": r"[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z] ?\d[ABCEGHJ-NPRSTV-Z]\d", "NL": r"\d{4} ?[A-Z]{2}", "PL": r"\d{2}-\d{3}", "PT": r"\d{4}-\d{3}", "BR": r"\d{5}-?\d{3}",
    "JP": r"\d{3}-?\d{4}", "US": r"\d{5}(?:-\d{4})?", "IE": r"[A-Z]\d{2} ?[A-Z0-9]{4}|D6W ?[A-Z0-9]{4}", "MT": r"[A-Z]{3} ?\d{4}", "AZ": r"AZ ?\d{4}", "AD": r"AD\d{3}", "BB": r"BB\d{5}", "MD": r"MD-?\d{4}", "LV": r"LV-?\d{4}",
    "LT": r"LT-?\d{5}", "GR CZ SK SE": r"\d{3} ?\d{2}", "KY": r"KY\d-\d{4}", "BM": r"[A-Z]{2} ?\d{2}", "TW": r"\d{3}(?:-?\d{2,3})?", "AR": r"[A-Z]?\d{4}[A-Z]{0,3}",
    "IS PG FO": r"\d{3}", "AT AU BE BG CH CY DK HU LI LU NO NZ PH SI ZA": r"\d{4}", "DE FR ES IT FI TR TH MY MX ID PK EG DZ MA KE UA KR SA": r"\d{5}", "CN IN SG RU KZ BY NG RO VN": r"\d{6}", "IL CL": r"\d{7}",
}
POSTAL_PATTERNS = {k: re.compile(v) for k, v in POSTAL.items()}


@detector("postal-code", "POSTAL_CODE", GLOBAL, r"\b(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|[A-Z]\d[A-Z] ?\d[A-Z]\d|\d{4} ?[A-Z]{2}|[A-Z]{2,3}[- ]?\d{4,5}|[A-Z]\d{2} ?[A-Z0-9]{4}|\d{2,7}(?:[- ]\d{2,4})?)\b", MEDIUM, context=True, hint=DIGIT)
def postal_code(m):
    s = m[0]
    if not apart(m, ".,") or re.fullmatch(r"19\d\d|20\d\d", s):
        return None
    fits = [c for k, p in POSTAL_PATTERNS.items() if p.fullmatch(s) for c in k.split()]
    return Verdict(MEDIUM, s, True, "postal-format-table", metadata={"countries": ",".join(fits)}) if fits else None


# Words for streets.
WESTERN = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Square|Sq|Crescent|Close|Gardens"
ROMANCE = "rue|avenue|boulevard|impasse|allée|chemin|place|quai|calle|avenida|paseo|plaza|carrer|via|viale|piazza|corso|rua|travessa|praça"
GERMANIC = "straße|strasse|weg|gasse|platz|allee|ring|damm|ufer|straat|laan|plein|gracht|kade|singel|gade|vej|gatan|vägen|veien|gata"
TURKISH = r"Caddesi|Cadde|Cad\.|Sokak|Sokağı|Sok\.|Bulvarı|Bulvar|Blv\.|Mahallesi|Mah\."
CAPITAL, LETTER = r"[^\W\d_a-zß-öø-ÿ]", r"[^\W\d_]"
STREETS = {
    "western": rf"\b\d{{1,5}}[A-Za-z]? {CAPITAL}(?:{LETTER}|[.'-])*(?: {CAPITAL}(?:{LETTER}|[.'-])*){{0,3}}? (?:{WESTERN})\b",
    "romance": rf"\b\d{{1,5}},? (?i:{ROMANCE}) {LETTER}+(?:[ '-]{LETTER}+){{0,3}}|\b(?i:{ROMANCE}) {LETTER}+(?:[ '-]{LETTER}+){{0,3}},? \d{{1,5}}\b",
    "germanic": rf"\b{CAPITAL}{LETTER}{{2,30}}?(?:{GERMANIC}) \d{{1,4}}[a-z]?\b",
    "turkish": rf"\b{CAPITAL}{LETTER}{{1,20}}(?: {CAPITAL}{LETTER}{{1,20}})? (?:{TURKISH})(?: No:? ?\d{{1,4}}(?:/\d{{1,3}})?)?",
    "east-asian": r"[一-鿿]{1,12}?(?:路|街|大道)\d{1,4}号(?:楼|栋)?|[一-鿿぀-ヿ]{1,12}\d{1,3}丁目(?:\d{1,3}番地?)?(?:\d{1,3}号)?|[가-힯]{2,12}(?:로|길) ?\d{1,4}(?:-\d{1,3})?",
    "arabic": r"شارع [؀-ۿ]{2,20}(?: [؀-ۿ]{2,20}){0,3}(?: \d{1,4})?",
}
SHAPES = {k: re.compile(v) for k, v in STREETS.items()}


@detector("street-address", "STREET_ADDRESS", GLOBAL, "|".join(STREETS.values()), MEDIUM, re.U, context=True, hint=r"\d|Cad|Sok|Bulvar|Blv|Mah|شارع")
def street(m):
    return Verdict(MEDIUM, m[0].strip(), True, "address-heuristic", metadata={"convention": next((k for k, p in SHAPES.items() if p.fullmatch(m[0])), "other")})


# secrets
# Shapes that have entropy and are no secrets.
NOT_SECRET = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-f]{40}|[0-9a-f]{64}|x+|X+|\*+|\.+|-+|0+|.*your[_-]?(?:api[_-]?)?key.*|.*[_-]?here|changeme|placeholder|redacted|example|sample|dummy|todo|data:.*", re.I | re.S)


def bits(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


@detector("generic-secret", "GENERIC_SECRET", GLOBAL, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,256}={0,2}(?![A-Za-z0-9+/_=-])", MEDIUM, context=True, hint=r"[A-Za-z0-9+/_-]{20}")
def generic_secret(m):
    s = m[0]
    if NOT_SECRET.fullmatch(s) or bits(s) < 3.5 or len(set(s)) < 10:
        return None
    return Verdict(MEDIUM, s, True, "entropy")


# VAT numbers: shape and rule of each country; "structural" where no arithmetic is published
def checked(s: str, weights, n: int, m: int = 11) -> int:
    return weigh(s[:n], weights) % m


def down(n: int, to: int = 1) -> range:
    return range(n, to, -1)


def lithuanian(b: str) -> bool:
    n = len(b) - 1
    first, second = [i % 9 + 1 for i in range(n)], [(i + 2) % 9 + 1 for i in range(n)]
    r = checked(b, first, n)
    return (checked(b, second, n) % 10 if r == 10 else r) == int(b[-1])


def bulgarian(b: str) -> bool:
    if len(b) == 9:
        r = checked(b, range(1, 9), 8)
        return (checked(b, range(3, 11), 8) % 10 if r == 10 else r) == int(b[8])
    return int(b[9]) in (checked(b, (21, 19, 17, 13, 11, 9, 7, 3, 1), 9, 10), checked(b, (2, 4, 8, 5, 10, 9, 7, 3, 6), 9) % 10)


def czech(b: str):
    if len(b) == 8:
        return {0: 1, 1: 0}.get(r := checked(b, down(8), 7), 11 - r) == int(b[7])
    return "structural" if len(b) == 9 else int(b) % 11 == 0


def french(b: str):
    if not luhn(b[2:]):
        return False
    return int(b[:2]) == (12 + 3 * (int(b[2:]) % 97)) % 97 if b[:2].isdigit() else "structural"


def cif(b: str) -> bool:
    value = -folded(b[1:8], 0) % 10
    as_digit, as_letter = b[8] == str(value), b[8] == "JABCDEFGHI"[value]
    return as_digit if b[0] in "ABEH" else as_letter if b[0] in "KPQSNWR" else as_digit or as_letter


def spanish(b: str) -> bool:
    if b[:8].isdigit():
        return DNI[int(b[:8]) % 23] == b[8]
    if b[0] in "XYZ":
        return DNI[int(str("XYZ".index(b[0])) + b[1:8]) % 23] == b[8]
    return cif(b)


def irish(b: str) -> bool:
    return "WABCDEFGHIJKLMNOPQRSTUV"[(weigh(b[:7], down(8)) + (9 * (ord(b[8]) - 64) if len(b) > 8 else 0)) % 23] == b[7]


def cypriot(b: str) -> bool:
    odd = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)
    return chr(65 + sum(odd[int(c)] if i % 2 == 0 else int(c) for i, c in enumerate(b[:8])) % 26) == b[8]


VAT = {
    "AT": (r"U\d{8}", lambda b: -(folded(b[1:8], 1) + 4) % 10 == int(b[8])),
    "BE": (r"[01]\d{9}", lambda b: 97 - int(b[:8]) % 97 == int(b[8:])),
    "BG": (r"\d{9,10}", bulgarian),
    "CY": (r"\d{8}[A-Z]", cypriot),
    "CZ": (r"\d{8,10}", czech),
    "DE": (r"\d{9}", hybrid_11_10),
    "DK": (r"\d{8}", lambda b: checked(b, (2, 7, 6, 5, 4, 3, 2, 1), 8) == 0),
    "EE": (r"\d{9}", lambda b: -checked(b, (3, 7, 1, 3, 7, 1, 3, 7), 8, 10) % 10 == int(b[8])),
    "EL": (r"(?!0+$)\d{9}", lambda b: checked(b, [1 << k for k in down(8, 0)], 8) % 10 == int(b[8])),
    "ES": (r"\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[A-HJ-NP-SUVW]\d{7}[0-9A-J]", spanish),
    "FI": (r"\d{8}", lambda b: (r := checked(b, (7, 9, 10, 5, 8, 4, 2), 7)) != 1 and (11 - r) % 11 == int(b[7])),
    "FR": (r"[0-9A-Z]{2}\d{9}", french),
    "HR": (r"\d{11}", hybrid_11_10),
    "HU": (r"\d{8}", lambda b: -checked(b, (9, 7, 3, 1, 9, 7, 3), 7, 10) % 10 == int(b[7])),
    "IE": (r"\d{7}[A-W][AH]?", irish),
    "IT": (r"(?!0{7})\d{11}", luhn),
    "LT": (r"\d{9}|\d{12}", lithuanian),
    "LU": (r"\d{8}", lambda b: int(b[:6]) % 89 == int(b[6:])),
    "LV": (r"\d{11}", lambda b: (3 - weigh(b[:10], (9, 1, 4, 8, 3, 10, 2, 5, 7, 6))) % 11 == int(b[10])),
    "MT": (r"\d{8}", lambda b: 37 - checked(b, (3, 4, 6, 7, 8, 9), 6, 37) == int(b[6:])),
    "NL": (r"\d{9}B\d{2}", lambda b: checked(b, down(9), 8) == int(b[8]) or int(numeric("NL" + b)) % 97 == 1),
    "PL": (r"\d{10}", lambda b: checked(b, (6, 5, 7, 2, 3, 4, 5, 6, 7), 9) == int(b[9])),
    "PT": (r"\d{9}", lambda b: complement11(down(9), b)),
    "RO": (r"[1-9]\d{1,9}", lambda b: checked(b.zfill(10), (7, 5, 3, 2, 1, 7, 5, 3, 2), 9) * 10 % 11 % 10 == int(b[-1])),
    "SE": (r"\d{10}01", lambda b: luhn(b[:10])),
    "SI": (r"[1-9]\d{7}", lambda b: (r := checked(b, down(8), 7)) != 1 and (11 - r) % 11 == int(b[7])),
    "SK": (r"[1-9]\d[234789]\d{7}", lambda b: int(b) % 11 == 0),
}


@detector("eu-vat", "VAT_NUMBER", " ".join(VAT), r"\b(" + "|".join(VAT) + r") ?([0-9A-Z]{2,13})\b", HIGH, hint=DIGIT)
def eu_vat(m):
    shape, rule = VAT[m[1]]
    found = bool(re.fullmatch(shape, m[2], re.A)) and rule(m[2])
    return Verdict(MEDIUM if found == "structural" else HIGH, m[1] + m[2], True, "vat-structure" if found == "structural" else "vat-check", metadata={"country": m[1]}) if found else None


# national and tax ids
# Prefixes of employer numbers, governorates, states, letters of months, letter codes, odd values.
EIN = set("01 02 03 04 05 06 10 11 12 13 14 15 16 20 21 22 23 24 25 26 27 30 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48 50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 71 72 73 74 75 76 77 80 81 82 83 84 85 86 87 88 90 91 92 93 94 95 98 99".split())
GOVERNORATES = set("01 02 03 04 11 12 13 14 15 16 17 18 19 21 22 23 24 25 26 27 28 29 31 32 33 34 35 88".split())
MX_STATES = set("AS BC BS CC CL CM CS CH DF DG GT GR HG JC MC MN MS NT NL OC PL QT QR SP SL SR TC TS TL VZ YN ZS NE".split())
MONTHS = "ABCDEHLMPRST"
TW_LETTERS = {"A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16, "H": 17, "I": 34, "J": 18, "K": 19, "L": 20, "M": 21, "N": 22, "O": 35, "P": 23, "Q": 24, "R": 25, "S": 26, "T": 27, "U": 28, "V": 29, "W": 32, "X": 30, "Y": 31, "Z": 33}
IT_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
CURP = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"


def codice(s: str, m: re.Match) -> bool:
    at = lambda c: int(c) if c.isdigit() else ord(c) - 65
    total = sum(IT_ODD[at(c)] if i % 2 == 0 else at(c) for i, c in enumerate(s[:15]))
    return m[3] in MONTHS and 1 <= int(m[4]) % 40 <= 31 and int(m[4]) <= 71 and chr(65 + total % 26) == s[15]


def vkn(s: str, m: re.Match) -> bool:
    total = 0
    for p in range(1, 10):
        x = (int(s[p - 1]) + 10 - p) % 10
        total += 9 if x == 9 else x * 2 ** (10 - p) % 9
    return -total % 10 == int(s[9])


def hong_kong(s: str, m: re.Match) -> bool:
    value = lambda c: 36 if c == " " else ord(c) - 55
    a, b = m[1].rjust(2)
    return (9 * value(a) + 8 * value(b) + weigh(m[2], down(7)) + (10 if m[3] == "A" else int(m[3]))) % 11 == 0


def zealand(s: str, m: re.Match) -> bool:
    p = s.zfill(9)
    for weights in ((3, 2, 7, 6, 5, 4, 3, 2), (7, 4, 3, 2, 5, 2, 7, 6)):
        c = -weigh(p[:8], weights) % 11
        if c < 10:
            return c == int(p[8]) and 10_000_000 <= int(s) <= 150_000_000
    return False


number("national-id-us-ein", T, "US", r"\b(\d{2})-(\d{7})\b", lambda s, m: s[:2] in EIN, "ein-prefix-table", MEDIUM)
number("national-id-de-personalausweis", N, "DE", r"\b[0-9CFGHJKLMNPRTVWXYZ]{9}\d\b", lambda s, m: not s.isdigit() and icao(s[:9]) == int(s[9]), "icao-731")
number("national-id-es-cif", T, "ES", r"\b([A-HJ-NP-SUVW])[- ]?(\d{7})[- ]?([0-9A-J])\b", lambda s, m: cif(s), "cif-check")
number("national-id-it-codice-fiscale", N, "IT", r"\b([A-Z]{6})(\d{2})([A-Z])(\d{2})([A-Z]\d{3})([A-Z])\b", codice, "cin")
number("national-id-cz-rodne-cislo", N, "CZ SK", r"\b(\d{2})(\d{2})(\d{2})/?(\d{4})\b", lambda s, m: day(m[3], int(m[2]) % 50 - 20 * (int(m[2]) % 50 > 20)) and int(s) % 11 == 0, "mod11-divisibility")
number("national-id-hu-szemelyi", N, "HU", r"\b([1-8])(\d{2})(\d{2})(\d{2})[- ]?(\d{4})\b", lambda s, m: day(m[4], m[3]) and weigh(s[:10], range(1, 11)) % 11 == int(s[10]), "szemelyi-mod11")
number("national-id-kz-iin", N, "KZ", r"\b(\d{2})(\d{2})(\d{2})([1-6])(\d{4})(\d)\b", lambda s, m: day(m[3], m[2]) and two_phase(s, range(1, 12), [(i + 2) % 11 + 1 for i in range(11)], 11), "iin-two-phase-mod11")
number("national-id-tr-vkn", T, "TR", r"\b\d{10}\b", vkn, "vkn-transform")
number("national-id-qa-qid", N, "QA", r"\b[23]\d{10}\b", lambda s, m: True, "qid-structure", MEDIUM)
number("national-id-eg", N, "EG", r"\b([23])(\d{2})(\d{2})(\d{2})(\d{2})(\d{4})(\d)\b", lambda s, m: day(m[4], m[3]) and m[5] in GOVERNORATES, "eg-id-structure", MEDIUM)
number("national-id-tw", N, "TW", r"\b([A-Z])([1289])(\d{7})(\d)\b", lambda s, m: (TW_LETTERS[s[0]] // 10 + TW_LETTERS[s[0]] % 10 * 9 + weigh(s[1:9], down(8, 0)) + int(s[9])) % 10 == 0, "tw-mod10")
number("national-id-hk-hkid", N, "HK", r"\b([A-Z]{1,2})(\d{6})[(\[]?([0-9A])[)\]]?(?!\w)", hong_kong, "hkid-mod11")
number("national-id-bd-nid", N, "BD", r"\b(19\d{2}|20\d{2})\d{13}\b", lambda s, m: True, "nid-structure", MEDIUM)
number("national-id-id-nik", N, "ID", r"\b([1-9]\d)(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{4})\b", lambda s, m: 11 <= int(m[1]) <= 94 and day(int(m[4]) - 40 * (int(m[4]) > 40), m[5]) and m[7] != "0000", "nik-structure", MEDIUM)
number("national-id-vn-cccd", N, "VN", r"\b(0\d{2})(\d)(\d{2})(\d{6})\b", lambda s, m: 1 <= int(m[1]) <= 96, "cccd-structure", MEDIUM)
number("national-id-nz-ird", T, "NZ", r"\b(\d{2,3})-(\d{3})-(\d{3})\b|\b(\d{8,9})\b", zealand, "ird-two-phase-mod11")
number("national-id-mx-curp", N, "MX", r"\b([A-ZÑ]{4})(\d{2})(\d{2})(\d{2})([HM])([A-Z]{2})([A-ZÑ]{3})([0-9A-Z])(\d)\b", lambda s, m: day(m[4], m[3]) and m[6] in MX_STATES and -sum(CURP.index(c) * (18 - i) for i, c in enumerate(m[0][:17])) % 10 == int(m[9]), "curp-mod10", flags=re.U)
number("national-id-mx-rfc", T, "MX", r"\b([A-ZÑ&]{4})(\d{2})(\d{2})(\d{2})([A-Z0-9]{3})\b", lambda s, m: day(m[4], m[3]), "rfc-structure", MEDIUM, flags=re.U)
number("national-id-ar-dni", N, "AR", r"\bDNI:?\s*(\d{1,2}\.\d{3}\.\d{3})\b", lambda s, m: True, "dni-labeled", MEDIUM, 1)
