"""The detector catalogue: a pattern that proposes spans, and a validator that confirms them by structure or check digit.

Validators take the match and return None (not one), or a Verdict. Patterns run with ASCII classes.
"""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from veilframe.functions.checks import hybrid_11_10, icao, luhn, numeric, pure_11_2, verhoeff, weigh

LOW, MEDIUM, HIGH, MAXIMUM = 0.3, 0.6, 0.85, 0.99
GLOBAL = "GLOBAL"


@dataclass(frozen=True)
class Verdict:
    confidence: float | None = None
    canonical: str | None = None
    sensitive: bool = True
    validator: str = ""
    span: tuple[int, int] | None = None
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class DetectorSpec:
    id: str
    entity_type: str
    regions: tuple[str, ...]
    pattern: str
    confidence: float
    validate: Callable[[re.Match], Verdict | None]
    requires_context: bool = False
    flags: int = re.A
    #: What every match's lines, or the lines beside them, must hold; "" for none. Lets scans pass over other lines.
    hint: str = ""

    def __post_init__(self):
        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", self.id) or not self.regions or not 0 < self.confidence <= 1:
            raise ValueError(f"not a detector: {self.id}")


CATALOG: dict[str, DetectorSpec] = {}


def register_detector(spec: DetectorSpec) -> DetectorSpec:
    if spec.id in CATALOG:
        raise ValueError(f"detector {spec.id} exists")
    CATALOG[spec.id] = spec
    return spec


def detectors(region: str | None = None, types: set[str] | None = None) -> list[DetectorSpec]:
    return [d for d in CATALOG.values() if (region is None or GLOBAL in d.regions or region in d.regions) and (types is None or d.entity_type in types)]


def detector(id: str, kind: str, regions: str, pattern: str, confidence: float, flags: int = re.A, context: bool = False, hint: str = ""):
    def add(validate):
        register_detector(DetectorSpec(id, kind, tuple(regions.split()), pattern, confidence, validate, context, flags, hint))
        return validate

    return add


DIGIT = r"[0-9]"


def before_of(m: re.Match) -> str:
    """The character before a match, "" at the beginning."""
    return m.string[m.start() - 1] if m.start() else ""


def plain(m: re.Match) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", m[0])


def apart(m: re.Match, more: str = "") -> bool:
    """Not a fragment of a longer number."""
    before, after = before_of(m), m.string[m.end() : m.end() + 2]
    return not (before and (before.isdigit() or before in "-" + more) or after[:1].isdigit() or after[:1] in ("-", *more) and after[1:2].isdigit())


def day(dd: str | int, mm: str | int) -> bool:
    return 1 <= int(mm) <= 12 and 1 <= int(dd) <= 31


def number(id: str, kind: str, region: str, pattern: str, rule: Callable, validator: str, confidence: float = HIGH, group: int | None = None, flags: int = re.A, check_apart: bool = True, hint: str = DIGIT):
    """A detector for an id number: rule(alphanumerics, match) is true for a valid one."""

    def validate(m: re.Match) -> Verdict | None:
        if check_apart and group is None and not apart(m):
            return None
        s = plain(m) if group is None else re.sub(r"[^0-9A-Za-z]", "", m[group])
        try:
            ok = rule(s, m)
        except (ValueError, IndexError):
            ok = False
        if not ok:
            return None
        return Verdict(confidence, s, ok != "test", validator, m.span(group) if group else None, {"region": region.split()[0]})

    register_detector(DetectorSpec(id, kind, tuple(region.split()), pattern, confidence, validate, False, flags, hint))


def mod11(weights, s: str, ten: int | None = None) -> bool:
    r = weigh(s, weights) % 11
    return (ten if r == 10 and ten is not None else r) == int(s[len(weights)])


def complement11(weights, s: str, low: int = 0) -> bool:
    """The check digit is 11 - sum mod 11, with 10 and 11 as low."""
    c = 11 - weigh(s, weights) % 11
    return (low if c > 9 else c) == int(s[len(weights)])


def repeated(s: str) -> bool:
    return len(set(s)) == 1


N, T = "NATIONAL_ID", "TAX_ID"

# bank codes
number("au-bsb", "AU_BSB", "AU", r"\b\d{3}-\d{3}\b", lambda s, m: True, "bsb-structural", MEDIUM)
number("br-agencia", "BR_AGENCIA", "BR", r"\b[Aa]g(?:ência|encia|\.)?\s*:?\s*(\d{4}(?:-\d)?)\b", lambda s, m: True, "agencia-labeled", MEDIUM, 1)
number("in-ifsc", "IN_IFSC", "IN", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", lambda s, m: any(c.isdigit() for c in s[5:]), "ifsc-structural")
number("uk-sort-code", "UK_SORT_CODE", "GB", r"\b\d{2}-\d{2}-\d{2}\b", lambda s, m: True, "sort-code-structural", MEDIUM)
number("us-routing-number", "US_ROUTING_NUMBER", "US", r"\b\d{9}\b", lambda s, m: (1 <= int(s[:2]) <= 12 or 21 <= int(s[:2]) <= 32 or 61 <= int(s[:2]) <= 72 or s[:2] == "80") and weigh(s, [3, 7, 1] * 3) % 10 == 0, "aba-frb-prefix")

# contact
RESERVED = {"test", "example", "invalid", "localhost"}


@detector("email", "EMAIL", GLOBAL, r"""(?:"[^"\r\n]{1,62}"|[\w!#$%&'*+/=?^`{|}~.-]+)@[^\W_](?:[^\W_]|-){0,61}(?:\.[^\W_](?:[^\W_]|-){0,62})+""", HIGH, re.U, hint="@")
def email(m):
    raw = m[0].lstrip(".'")
    start = m.start() + len(m[0]) - len(raw)
    local, _, domain = raw.rpartition("@")
    labels = domain.split(".")
    if len(raw) > 254 or not 0 < len(local) <= 64 or local[-1] == "." or ".." in local or len(labels) < 2:
        return None
    if any(not 1 <= len(x) <= 63 or x[0] == "-" or x[-1] == "-" for x in labels) or len(labels[-1]) < 2 or labels[-1].isdigit():
        return None
    low = [x.lower() for x in labels]
    reserved = low[-1] in RESERVED or low[-2:] in (["example", t] for t in ("com", "net", "org"))
    return Verdict(HIGH, f"{local}@{domain.lower()}", not reserved, "email-structural", (start, m.end()))


@detector("ip-v4", "IP_ADDRESS", GLOBAL, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", HIGH, hint=DIGIT)
def ipv4(m):
    before, after = before_of(m), m.string[m.end() : m.end() + 2]
    parts = m[0].split(".")
    if before and (before in ".vV" or before.isdigit()) or after[:1] == "." and after[1:2].isdigit() or any(int(p) > 255 for p in parts):
        return None
    a = ipaddress.IPv4Address(".".join(str(int(p)) for p in parts))
    documentation = any(a in ipaddress.ip_network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"))
    if documentation:
        return Verdict(MEDIUM, str(a), False, "ipv4-range", metadata={"scope": "documentation"})
    if int(a) in (0, 2**32 - 1):
        return Verdict(LOW, str(a), False, "ipv4-range", metadata={"scope": "unspecified" if not int(a) else "broadcast"})
    return Verdict(HIGH if a.is_global else MEDIUM, str(a), True, "ipv4-range", metadata={"scope": "public" if a.is_global else "special"})


@detector("ip-v6", "IP_ADDRESS", GLOBAL, r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,45}(?:\.\d{1,3}(?:\.\d{1,3}){2})?(?:%[0-9A-Za-z._~-]{1,16})?(?![\w:])", HIGH, hint=":")
def ipv6(m):
    try:
        a = ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    if a.is_unspecified:
        return Verdict(LOW, str(a), False, "ipv6-parse")
    if a in ipaddress.ip_network("2001:db8::/32"):
        return Verdict(MEDIUM, str(a), False, "ipv6-parse")
    return Verdict(HIGH if a.is_global else MEDIUM, str(a), True, "ipv6-parse")


@detector("mac-address", "MAC_ADDRESS", GLOBAL, r"\b(?:[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}|[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4})\b", HIGH, hint=r"[0-9A-Fa-f]{2}[:.-][0-9A-Fa-f]{2}")
def mac(m):
    if before_of(m) in (":", "-", ".") or re.match(r"[:.-][0-9A-Fa-f]", m.string[m.end() : m.end() + 2]):
        return None
    s = plain(m).lower()
    if s in ("f" * 12, "0" * 12):
        return Verdict(LOW, s, False, "mac-structural")
    return Verdict(HIGH, s, True, "mac-structural")


@detector("phone", "PHONE", GLOBAL, r"[+(]?\d[\d \t()./-]{4,22}\d", HIGH, hint=DIGIT)
def phone(m):
    s = re.sub(r"\D", "", m[0])
    # without metadata of all plans: international numbers by length, those of the North American plan by its rules too
    if m[0].startswith("+"):
        fits = north_american(s[1:]) if s[0] == "1" else 8 <= len(s) <= 15 and s[0] != "0"
        return Verdict(HIGH, f"+{s}", True, "international-length", metadata={"region": "US"} if s[0] == "1" else {}) if fits else None
    if m[0].startswith("(") and re.fullmatch(r"\(\d{3}\) ?\d{3}[-. ]\d{4}", m[0]) and north_american(s):
        return Verdict(MEDIUM, f"+1{s}", True, "national-plan", metadata={"region": "US"})
    return None


def north_american(s: str) -> bool:
    """Ten digits; area and exchange begin with 2 to 9 and end in no 11; 555-01xx is for fiction."""
    return len(s) == 10 and s[0] in "23456789" and s[3] in "23456789" and s[1:3] != "11" and s[4:6] != "11" and not s[3:8] == "55501"


# financial
# Issuer prefixes, the longest first, as (low, high, issuer); lengths by issuer; published test numbers.
BIN_RANGES = [
    (622126, 622925, "discover"), (506099, 506198, "verve"), (507865, 507964, "verve"), (650002, 650027, "verve"), (401178, 401179, "elo"), (431274, 431274, "elo"),
    (438935, 438935, "elo"), (451416, 451416, "elo"), (457393, 457393, "elo"), (457631, 457632, "elo"), (504175, 504175, "elo"), (506699, 506778, "elo"),
    (509000, 509999, "elo"), (627780, 627780, "elo"), (636297, 636297, "elo"), (636368, 636368, "elo"), (650031, 650051, "elo"), (650405, 650439, "elo"),
    (650485, 650538, "elo"), (650541, 650598, "elo"), (650700, 650727, "elo"), (650901, 650978, "elo"), (651652, 651679, "elo"), (655000, 655058, "elo"),
    (9792, 9792, "troy"), (2200, 2204, "mir"), (3528, 3589, "jcb"), (2221, 2720, "mastercard"), (6011, 6011, "discover"), (6521, 6522, "rupay"), (3095, 3095, "diners"),
    (300, 305, "diners"), (644, 649, "discover"), (508, 508, "rupay"),
    (34, 34, "amex"), (37, 37, "amex"), (36, 36, "diners"), (38, 39, "diners"), (51, 55, "mastercard"), (65, 65, "discover"), (62, 62, "unionpay"), (60, 60, "rupay"),
    (81, 82, "rupay"), (50, 50, "maestro"), (56, 59, "maestro"), (61, 61, "maestro"), (63, 64, "maestro"), (66, 69, "maestro"),
    (4, 4, "visa"),
]
ISSUER_LENGTHS = {
    "visa": (13, 16, 19), "mastercard": (16,), "amex": (15,), "discover": (16, 17, 18, 19), "jcb": (16, 17, 18, 19), "unionpay": (16, 17, 18, 19), "diners": (14, 15, 16, 17, 18, 19),
    "maestro": (12, 13, 14, 15, 16, 17, 18, 19), "troy": (16,), "mir": (16, 17, 18, 19), "rupay": (16,), "elo": (16,), "verve": (16, 18, 19),
}
TEST_CARDS = {
    "4111111111111111", "4012888888881881", "4222222222222", "4000056655665556", "4917610000000000", "5555555555554444", "5105105105105100", "5200828282828210", "2223003122003222",
    "378282246310005", "371449635398431", "378734493671000", "6011111111111117", "6011000990139424", "6011981111111113", "3530111333300000", "3566002020360505", "30569309025904",
    "38520000023237", "6200000000000005", "6200000000000047", "2200000000000053",
}


def issuer_of(s: str) -> str | None:
    """The issuer of a card number by its prefix, None where the length isn't one of that issuer."""
    found = next((name for low, high, name in BIN_RANGES if low <= int(s[: len(str(low))]) <= high), None)
    return found if found and len(s) in ISSUER_LENGTHS[found] else None


@detector("credit-card", "CREDIT_CARD", GLOBAL, r"\b\d(?:[ -]?\d){11,18}\b", HIGH, hint=DIGIT)
def credit_card(m):
    s = plain(m)
    issuer = issuer_of(s)
    if not issuer or not luhn(s) or not apart(m):
        return None
    return Verdict(HIGH, s, s not in TEST_CARDS, "luhn-bin", metadata={"issuer": issuer})


# Account numbers behind the country and check digits, as runs of digits (n), letters (a) or both (c); specimens.
IBAN_STRUCTURES = {
    "AD": "8n12c", "AE": "19n", "AL": "8n16c", "AT": "16n", "AZ": "4a20c", "BA": "16n", "BE": "12n", "BG": "4a6n8c", "BH": "4a14c", "BI": "23n", "BR": "23n1a1c", "BY": "4c4n16c",
    "CH": "5n12c", "CR": "18n", "CY": "8n16c", "CZ": "20n", "DE": "18n", "DJ": "23n", "DK": "14n", "DO": "4c20n", "EE": "16n", "EG": "25n", "ES": "20n", "FI": "14n",
    "FK": "2a12n", "FO": "14n", "FR": "10n11c2n", "GB": "4a14n", "GE": "2a16n", "GI": "4a15c", "GL": "14n", "GR": "7n16c", "GT": "4c20c", "HN": "4a20n", "HR": "17n", "HU": "24n",
    "IE": "4a14n", "IL": "19n", "IQ": "4a15n", "IS": "22n", "IT": "1a10n12c", "JO": "4a4n18c", "KW": "4a22c", "KZ": "3n13c", "LB": "4n20c", "LC": "4a24c", "LI": "5n12c", "LT": "16n",
    "LU": "3n13c", "LV": "4a13c", "LY": "21n", "MC": "10n11c2n", "MD": "20c", "ME": "18n", "MK": "3n10c2n", "MN": "16n", "MR": "23n", "MT": "4a5n18c", "MU": "4a19n3a", "NI": "4a20n",
    "NL": "4a10n", "NO": "11n", "OM": "3n16c", "PK": "4a16c", "PL": "24n", "PS": "4a21c", "PT": "21n", "QA": "4a21c", "RO": "4a16c", "RS": "18n", "RU": "14n15c", "SA": "2n18c",
    "SC": "4a20n3a", "SD": "14n", "SE": "20n", "SI": "15n", "SK": "20n", "SM": "1a10n12c", "SO": "19n", "ST": "21n", "SV": "4a20n", "TL": "19n", "TN": "20n", "TR": "5n17c",
    "UA": "6n19c", "VA": "18n", "VG": "4a16n", "XK": "16n",
}
SPECIMEN_IBANS = {
    "GB82WEST12345698765432", "GB29NWBK60161331926819", "DE89370400440532013000", "DE75512108001245126199", "FR1420041010050500013M02606", "FR7630006000011234567890189",
    "NL91ABNA0417164300", "BE68539007547034", "ES9121000418450200051332", "IT60X0542811101000000123456", "CH9300762011623852957", "AT611904300234573201",
    "TR330006100519786457841326", "PL61109010140000071219812874", "SE4550000000058398257466", "DK5000400440116243", "NO9386011117947", "FI2112345600000785",
}
IBAN_BODY = {c: re.compile(re.sub(r"(\d+)([nac])", lambda m: {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}[m[2]] + f"{{{m[1]}}}", s)) for c, s in IBAN_STRUCTURES.items()}
IBAN_LENGTHS = {c: 4 + sum(map(int, re.findall(r"\d+", s))) for c, s in IBAN_STRUCTURES.items()}


@detector("iban", "IBAN", GLOBAL, r"\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){10,32}", HIGH, hint=DIGIT)
def iban(m):
    n, taken, end = IBAN_LENGTHS.get(m[0][:2].upper(), 0), "", m.start()
    while n and len(taken) < n and end < m.end():
        taken += "" if m.string[end] == " " else m.string[end]
        end += 1
    taken = taken.upper()
    if not n or len(taken) < n or m.string[end : end + 1].isalnum() or not IBAN_BODY[taken[:2]].fullmatch(taken[4:]) or int(numeric(taken[4:] + taken[:4])) % 97 != 1:
        return None
    return Verdict(HIGH, taken, taken not in SPECIMEN_IBANS, "iban-mod97-structure", (m.start(), end), {"country": taken[:2].upper()})


COUNTRIES = set("AD AE AF AG AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BN BO BR BS BT BW BY BZ CA CD CF CG CH CI CL CM CN CO CR CU CV CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ FR GA GB GD GE GH GM GN GQ GR GT GW GY HK HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP KE KG KH KM KR KW KZ LA LB LI LK LR LS LT LU LV LY MA MC MD ME MG MK ML MM MN MO MR MT MU MV MW MX MY MZ NA NE NG NI NL NO NP NZ OM PA PE PG PH PK PL PT PY QA RO RS RU RW SA SC SD SE SG SI SK SL SN SO SR SV SY TD TG TH TJ TM TN TO TR TT TW TZ UA UG US UY UZ VE VN YE ZA ZM ZW".split())


@detector("swift-bic", "SWIFT_BIC", GLOBAL, r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", MEDIUM, hint="[A-Z]{6}")
def bic(m):
    s = m[0]
    if s[4:6] not in COUNTRIES or s[6] in "01":
        return None
    return Verdict(HIGH if len(s) == 11 or any(c.isdigit() for c in s) else MEDIUM, s, s[7] != "0", "bic-structural")


# crypto wallets
B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
B32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base58(s: str) -> bytes | None:
    n = 0
    for c in s:
        if (v := B58.find(c)) < 0:
            return None
        n = n * 58 + v
    return b"\0" * (len(s) - len(s.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def base58check(s: str) -> bytes | None:
    raw = base58(s)
    if raw is None or len(raw) < 5:
        return None
    twice = hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()
    return raw[:-4] if twice[:4] == raw[-4:] else None


def bech32(s: str) -> tuple[str, list[int], int] | None:
    """(prefix, five-bit data without the checksum, checksum constant)."""
    if s != s.lower() and s != s.upper():
        return None
    prefix, sep, data = s.lower().rpartition("1")
    values = [B32.find(c) for c in data]
    if not sep or len(values) < 6 or -1 in values:
        return None
    check = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *values]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return prefix, values[:-6], check


def segwit(s: str, prefix: str) -> bool:
    got = bech32(s)
    return bool(got and got[0] == prefix and got[1] and got[2] == (1 if got[1][0] == 0 else 0x2BC830A3))


def coin(id: str, pattern: str, rule: Callable[[str], bool], validator: str, confidence: float = HIGH):
    detector(id, "CRYPTO_WALLET", GLOBAL, pattern, confidence, hint=r"[0-9A-Za-z]{14}")(lambda m: Verdict(confidence, m[0], True, validator, metadata={"chain": id.split("-")[1]}) if rule(m[0]) else None)


version = lambda s, *v: (raw := base58check(s)) is not None and len(raw) == 21 and raw[0] in v
coin("crypto-btc", r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|(?:bc1|BC1)[0-9A-Za-z]{11,87})\b", lambda s: segwit(s, "bc") if s[:2].lower() == "bc" else version(s, 0, 5), "base58check")
coin("crypto-ltc", r"\b(?:[LM][1-9A-HJ-NP-Za-km-z]{25,34}|(?:ltc1|LTC1)[0-9A-Za-z]{11,87})\b", lambda s: segwit(s, "ltc") if s[:3].lower() == "ltc" else version(s, 0x30, 0x32), "base58check")
coin("crypto-trx", r"\bT[1-9A-HJ-NP-Za-km-z]{33}\b", lambda s: version(s, 0x41), "base58check")
coin("crypto-sol", r"\b[1-9A-HJ-NP-Za-km-z]{32,44}\b", lambda s: len(base58(s) or b"") == 32, "sol-structural", MEDIUM)
coin("crypto-dot", r"\b1[1-9A-HJ-NP-Za-km-z]{44,50}\b", lambda s: len(raw := base58(s) or b"") == 35 and raw[0] == 0, "ss58-structural", MEDIUM)
coin("crypto-ada", r"\b(?:addr1[02-9ac-hj-np-z]{20,110}|(?:Ae2|DdzFF)[1-9A-HJ-NP-Za-km-z]{20,120})\b", lambda s: bool((got := bech32(s)) and got[0] == "addr" and got[2] == 1) if s.startswith("addr1") else len(base58(s) or b"") >= 30, "bech32")

# documents
number("vin", "VIN", GLOBAL, r"\b[A-HJ-NPR-Z0-9]{17}\b", lambda s, m: not s.isdigit() and "0123456789X"[sum(int(c if c.isdigit() else "12345678*12345*7*923456789"["ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)]) * w for c, w in zip(s, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2))) % 11] == s[8], "iso3779", check_apart=False, hint=r"[A-Z0-9]{17}")
number("us-npi", "US_NPI", "US", r"\b\d{10}\b", lambda s, m: s[0] in "12" and luhn("80840" + s), "luhn-80840")


@detector("passport-mrz", "PASSPORT_MRZ", GLOBAL, r"(?:^|\n)(?:[A-Z0-9<]{30}\r?\n[A-Z0-9<]{30}\r?\n[A-Z0-9<]{30}|[A-Z0-9<]{44}\r?\n[A-Z0-9<]{44}|[A-Z0-9<]{36}\r?\n[A-Z0-9<]{36})", MAXIMUM, hint="[A-Z0-9<]{30}")
def mrz(m):
    raw = m[0].lstrip("\n")
    lines = raw.replace("\r", "").split("\n")
    if len(lines) == 3:
        a, b = lines[0], lines[1]
        fields = [(a[5:14], a[14]), (b[0:6], b[6]), (b[8:14], b[14]), (a[5:30] + b[0:7] + b[8:15] + b[18:29], b[29])]
    else:
        b = lines[1]
        last = (b[0:10] + b[13:20] + b[21:43], b[43]) if len(b) == 44 else (b[0:10] + b[13:20] + b[21:35], b[35])
        fields = [(b[0:9], b[9]), (b[13:19], b[19]), (b[21:27], b[27]), last]
    if any(not c.isdigit() or icao(f) != int(c) for f, c in fields):
        return None
    return Verdict(MAXIMUM, "\n".join(lines), True, "icao9303-all-check-digits", (m.end() - len(raw), m.end()))


# Units of laboratory results.
LAB_UNITS = "mg/dL|mmol/L|g/dL|mIU/L|IU/L|U/L|ng/mL|pg/mL|µg/L|μg/L|ug/L|µIU/mL|μIU/mL|uIU/mL|%|mEq/L|k/µL|k/μL|K/uL|fL"


@detector("health-data", "HEALTH_DATA", GLOBAL, r"\b(?:[A-TV-Z]\d{2}\.[A-Z0-9]{1,4}|\d{6,18}|\d+(?:\.\d+)?\s?(?:" + LAB_UNITS + r")(?:\s?[\[(]\s?\d+(?:\.\d+)?\s?[-–]\s?\d+(?:\.\d+)?\s?[\])])?)(?!\w)", MEDIUM, hint=DIGIT)
def health(m):
    s = m[0]
    if s.isdigit():
        ok = s[-3:-1] in {"00", "01", "02", "03", "04", "05", "10", "11", "12", "13", "14", "15"} and verhoeff(s) and apart(m)
        return Verdict(MEDIUM, s, True, "sctid-verhoeff") if ok else None
    return Verdict(MEDIUM, s, True, "icd10-structure") if s[0].isalpha() else Verdict(LOW, s, True, "lab-pattern")


# secrets
# Provider prefixes and the least length of what follows.
PROVIDERS = {"github_pat_": 20, "ghp_": 36, "gho_": 36, "ghu_": 36, "ghs_": 36, "sk_live_": 16, "sk_test_": 16, "pk_live_": 16, "rk_live_": 16, "xoxb-": 20, "xoxp-": 20, "AIza": 35, "AKIA": 16, "ASIA": 16, "glpat-": 20, "npm_": 36, "hf_": 30, "SG.": 40, "dop_v1_": 64}
B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@detector("api-key", "API_KEY", GLOBAL, r"\b(?:" + "|".join(sorted(map(re.escape, PROVIDERS), key=len, reverse=True)) + r")[A-Za-z0-9._-]{9,129}[A-Za-z0-9_-]", HIGH, hint=r"[A-Za-z0-9._-]{14}")
def api_key(m):
    s = m[0]
    prefix = next(p for p in sorted(PROVIDERS, key=len, reverse=True) if s.startswith(p))
    body = s[len(prefix) :]
    if len(body) < PROVIDERS[prefix]:
        return None
    if re.fullmatch(r"gh[pousr]_", prefix):
        n, tail = zlib.crc32(body[:-6].encode()), ""
        for _ in range(6):
            n, r = divmod(n, 62)
            tail = B62[r] + tail
        if tail != body[-6:]:
            return None
    return Verdict(HIGH, s, "_test_" not in prefix, "provider-prefix", metadata={"provider": prefix})


@detector("jwt", "JWT", GLOBAL, r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{2,}\b", HIGH, hint="eyJ")
def jwt(m):
    head = m[0].split(".")[0]
    try:
        alg = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))).get("alg")
    except (ValueError, AttributeError):
        return None
    known = re.fullmatch(r"(?:HS|RS|ES|PS)(?:256|384|512)|none|EdDSA|ES256K", str(alg))
    return Verdict(HIGH, m[0], True, "jwt-structural", metadata={"alg": str(alg)}) if known else None


@detector("pem-private-key", "PRIVATE_KEY", GLOBAL, r"-----BEGIN ([A-Z0-9 ]+?)-----([\s\S]*?)-----END ([A-Z0-9 ]+?)-----", MAXIMUM)
def pem(m):
    ok = m[1] == m[3] and m[1].endswith("PRIVATE KEY") and re.search(r"[A-Za-z0-9+/=]{16}", m[2])
    return Verdict(MAXIMUM, m[0], True, "pem-armor") if ok else None


SCHEMES = set("postgres postgresql mysql mariadb mongodb mongodb+srv redis rediss amqp amqps mssql sqlserver oracle clickhouse cassandra cockroachdb jdbc ldap ldaps".split())


@detector("connection-string", "CONNECTION_STRING", GLOBAL, r"""\b[a-zA-Z][a-zA-Z0-9+]*://[^\s"'<>,|]*:[^\s"'<>,|@]*@[^\s"'<>,|]{2,300}""", HIGH, hint="://")
def connection(m):
    scheme, _, rest = m[0].partition("://")
    password = rest.rpartition("@")[0].partition(":")[2]
    if scheme.lower() not in SCHEMES or not password:
        return None
    return Verdict(HIGH, m[0], password.lower() not in {"password", "changeme", "secret", "xxx", "***"}, "connection-string")


@detector("url-with-credentials", "URL_WITH_CREDENTIALS", GLOBAL, r"""\b(?:https?|ftps?|ssh|git)://[^\s/"'<>:@]+:[^\s/"'<>@]+@[^\s"'<>]+""", HIGH, hint="://")
def url_credentials(m):
    """Hosts that are reserved for documentation hold no secret."""
    host = re.split(r"[/?#:]", m[0].partition("://")[2].rpartition("@")[2])[0].lower()
    labels = host.split(".")
    return Verdict(HIGH, m[0], not (labels[-1] in RESERVED or labels[-2:] in (["example", t] for t in ("com", "net", "org"))), "userinfo-password")


@detector("coordinates", "COORDINATES", GLOBAL, r"(?<![\d.])-?\d{1,3}\.\d{3,8}°?(?: ?[NS])?[,;]\s*-?\d{1,3}\.\d{3,8}°?(?: ?[EW])?(?![\d.])", MEDIUM, hint=DIGIT)
def coordinates(m):
    lat, lon = (float(x) for x in re.findall(r"-?\d+\.\d+", m[0])[:2])
    if abs(lat) > 90 or abs(lon) > 180 or lat == lon == 0:
        return None
    return Verdict(HIGH if re.search("[NSEW]", m[0]) else MEDIUM, f"{lat:.6f},{lon:.6f}", True, "coordinate-range")


# national and tax ids, by country
number("national-id-us-ssn", N, "US", r"\b(\d{3})[- ](\d{2})[- ](\d{4})\b", lambda s, m: (s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000") and ("test" if s in ("078051120", "219099999", "123456789") else True), "ssn-issuance-rules", MEDIUM)
number("national-id-us-itin", T, "US", r"\b(9\d{2})[- ](\d{2})[- ](\d{4})\b", lambda s, m: 70 <= int(s[3:5]) <= 88 or 90 <= int(s[3:5]) <= 92 or 94 <= int(s[3:5]) <= 99, "itin-group-ranges", MEDIUM)
number("national-id-ca-sin", N, "CA", r"\b(\d{3})[- ](\d{3})[- ](\d{3})\b|\b(\d{9})\b", lambda s, m: s[0] != "8" and luhn(s) and ("test" if s[0] == "0" else True), "luhn")
number("national-id-gb-nino", N, "GB", r"\b([A-Z]{2})[ ]?(\d{2})[ ]?(\d{2})[ ]?(\d{2})[ ]?([A-D])\b", lambda s, m: s[0] not in "DFIQUV" and s[1] not in "DFIOQUV" and s[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"), "nino-prefix-rules", MEDIUM)
number("national-id-gb-nhs", N, "GB", r"\b(\d{3})[ -]?(\d{3})[ -]?(\d{4})\b", lambda s, m: complement11(range(10, 1, -1), s, -1) or (11 - weigh(s, range(10, 1, -1)) % 11 == 11 and s[9] == "0"), "nhs-mod11")
number("national-id-ie-pps", N, "IE", r"\b(\d{7})([A-W])([AH])?\b", lambda s, m: "WABCDEFGHIJKLMNOPQRSTUV"[(weigh(s[:7], range(8, 1, -1)) + (9 * (ord(s[8]) - 64) if len(s) > 8 else 0)) % 23] == s[7], "pps-mod23")
number("national-id-de-steuerid", T, "DE", r"\b[1-9]\d{2} ?\d{3} ?\d{3} ?\d{2}\b|\b[1-9]\d{10}\b", lambda s, m: sorted(s[:10].count(d) for d in set(s[:10]))[-1] in (2, 3) and hybrid_11_10(s), "iso7064-11-10")
number("national-id-fr-nir", N, "FR", r"\b([1-8])[ ]?(\d{2})[ ]?(\d{2})[ ]?(\d[0-9AB])[ ]?(\d{3})[ ]?(\d{3})[ ]?(\d{2})\b", lambda s, m: 97 - int(s[:13].upper().replace("A", "0").replace("B", "0")) % 97 + 0 == int(s[13:]) if not set(s.upper()) & set("AB") else 97 - (int(s[:13].upper().replace("A", "0").replace("B", "0")) - (1000000 if "A" in s.upper() else 2000000)) % 97 == int(s[13:]), "nir-mod97", flags=re.A | re.I)
DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
number("national-id-es-dni", N, "ES", r"\b(\d{8})[- ]?([A-Z])\b", lambda s, m: DNI[int(s[:8]) % 23] == s[8], "dni-mod23")
number("national-id-es-nie", N, "ES", r"\b([XYZ])[- ]?(\d{7})[- ]?([A-Z])\b", lambda s, m: DNI[int(str("XYZ".index(s[0])) + s[1:8]) % 23] == s[8], "nie-mod23")
number("national-id-nl-bsn", N, "NL", r"\b\d{9}\b", lambda s, m: not repeated(s) and weigh(s, (9, 8, 7, 6, 5, 4, 3, 2, -1)) % 11 == 0, "11-proef")
number("national-id-be-rijksregister", N, "BE", r"\b(\d{2})[. ]?(\d{2})[. ]?(\d{2})[- ]?(\d{3})[. ]?(\d{2})\b", lambda s, m: int(s[9:]) in (97 - int(s[:9]) % 97, 97 - int("2" + s[:9]) % 97), "rrn-mod97")
number("national-id-pl-pesel", N, "PL", r"\b\d{11}\b", lambda s, m: not repeated(s) and weigh(s, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1)) % 10 == 0 and day(s[4:6], int(s[2:4]) % 20), "pesel-mod10")
number("national-id-pl-nip", T, "PL", r"\b\d{3}[- ]?\d{3}[- ]?\d{2}[- ]?\d{2}\b", lambda s, m: not repeated(s) and mod11((6, 5, 7, 2, 3, 4, 5, 6, 7), s), "nip-mod11")
number("national-id-pl-regon", T, "PL", r"\b\d{9}\b", lambda s, m: not repeated(s) and mod11((8, 9, 2, 3, 4, 5, 6, 7), s, 0), "regon-mod11")
number("national-id-se-personnummer", N, "SE", r"\b(?:\d{2})?(\d{2})(\d{2})(\d{2})([-+]?)(\d{4})\b", lambda s, m: luhn(s[-10:]) and day((int(s[-6:-4]) - 1) % 60 + 1, s[-8:-6]), "luhn")
number("national-id-no-fodselsnummer", N, "NO", r"\b(\d{2})(\d{2})(\d{2})[ ]?(\d{5})\b", lambda s, m: weigh(s, (3, 7, 6, 1, 8, 9, 4, 5, 2, 1)) % 11 == 0 and weigh(s, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1)) % 11 == 0, "dual-mod11")
number("national-id-dk-cpr", N, "DK", r"\b(\d{2})(\d{2})(\d{2})-(\d{4})\b", lambda s, m: day(s[:2], s[2:4]), "cpr-date-structure", MEDIUM)
number("national-id-fi-hetu", N, "FI", r"\b(\d{2})(\d{2})(\d{2})([-+A-FU-Y])(\d{3})([0-9A-Y])\b", lambda s, m: day(m[1], m[2]) and "0123456789ABCDEFHJKLMNPRSTUVWXY"[int(m[1] + m[2] + m[3] + m[5]) % 31] == m[6], "hetu-mod31")
number("national-id-is-kennitala", N, "IS", r"\b(\d{2})(\d{2})(\d{2})-?(\d{2})(\d)(\d)\b", lambda s, m: day(int(s[:2]) % 40, s[2:4]) and complement11((3, 2, 7, 6, 5, 4, 3, 2), s), "kennitala-mod11")
number("national-id-pt-nif", T, "PT", r"\b[1-9]\d{8}\b", lambda s, m: complement11(range(9, 1, -1), s), "nif-mod11")
number("national-id-gr-afm", T, "GR", r"\b\d{9}\b", lambda s, m: not repeated(s) and sum(int(c) << (8 - i) for i, c in enumerate(s[:8])) % 11 % 10 == int(s[8]), "afm-mod11")
number("national-id-ro-cnp", N, "RO", r"\b([1-9])(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})(\d)\b", lambda s, m: day(s[5:7], s[3:5]) and mod11((2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9), s, 1), "cnp-mod11")
number("national-id-bg-egn", N, "BG", r"\b(\d{2})(\d{2})(\d{2})(\d{4})\b", lambda s, m: day(s[4:6], int(s[2:4]) % 20) and mod11((2, 4, 8, 5, 10, 9, 7, 3, 6), s, 0), "egn-mod11")
number("national-id-hr-oib", N, "HR", r"\b\d{11}\b", lambda s, m: hybrid_11_10(s), "iso7064-11-10")
number("national-id-si-emso", N, "SI", r"\b(\d{2})(\d{2})(\d{3})(\d{2})(\d{3})(\d)\b", lambda s, m: day(s[:2], s[2:4]) and complement11((7, 6, 5, 4, 3, 2) * 2, s), "emso-mod11")
number("national-id-tr-tckn", N, "TR", r"\b[1-9]\d{10}\b", lambda s, m: (7 * sum(map(int, s[0:9:2])) - sum(map(int, s[1:8:2]))) % 10 == int(s[9]) and sum(map(int, s[:10])) % 10 == int(s[10]), "tckn-dual-check")
number("national-id-ru-inn", T, "RU", r"\b\d{10}\b|\b\d{12}\b", lambda s, m: weigh(s, (2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == int(s[9]) if len(s) == 10 else weigh(s, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == int(s[10]) and weigh(s, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == int(s[11]), "inn-mod11")
number("national-id-ru-snils", N, "RU", r"\b(\d{3})-(\d{3})-(\d{3})[- ](\d{2})\b", lambda s, m: weigh(s, range(9, 0, -1)) % 101 % 100 == int(s[9:]), "snils-mod101")
number("national-id-ua-rnokpp", T, "UA", r"\b\d{10}\b", lambda s, m: weigh(s, (-1, 5, 7, 9, 4, 6, 10, 5, 7)) % 11 % 10 == int(s[9]), "rnokpp-mod11")
number("national-id-il-teudat-zehut", N, "IL", r"\b\d{9}\b", lambda s, m: not repeated(s) and luhn(s), "luhn")
number("national-id-sa", N, "SA", r"\b[12]\d{9}\b", lambda s, m: luhn(s), "luhn")
number("national-id-ae-emirates-id", N, "AE", r"\b784[- ]?(\d{4})[- ]?(\d{7})[- ]?(\d)\b", lambda s, m: luhn(s), "luhn")
number("national-id-kw-civil-id", N, "KW", r"\b[123]\d{11}\b", lambda s, m: 11 - weigh(s, (2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 3)) % 11 == int(s[11]), "civilid-mod11")
number("national-id-za", N, "ZA", r"\b(\d{2})(\d{2})(\d{2})(\d{4})(\d)(\d)(\d)\b", lambda s, m: day(s[4:6], s[2:4]) and s[10] in "01" and luhn(s), "luhn-date")
number("national-id-in-aadhaar", N, "IN", r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b", lambda s, m: verhoeff(s), "verhoeff")
number("national-id-in-pan", T, "IN", r"\b([A-Z]{3})([A-Z])([A-Z])(\d{4})([A-Z])\b", lambda s, m: m[2] in "ABCFGHJLPT", "pan-structure", MEDIUM)
number("national-id-cn-ric", N, "CN", r"\b(\d{2})(\d{4})(\d{4})(\d{2})(\d{2})(\d{3})([0-9Xx])\b", lambda s, m: day(m[5], m[4]) and 11 <= int(m[1]) <= 82 and pure_11_2(s), "iso7064-11-2")
number("national-id-kr-rrn", N, "KR", r"\b(\d{2})(\d{2})(\d{2})-([1-8])(\d{5})(\d)\b", lambda s, m: day(m[3], m[2]) and (11 - weigh(s, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11) % 10 == int(s[12]), "rrn-mod11")
number("national-id-jp-my-number", N, "JP", r"\b(\d{4})[ -]?(\d{4})[ -]?(\d{4})\b", lambda s, m: complement11((6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2), s), "mynumber-mod11")
number("national-id-th", N, "TH", r"\b([1-8])[ -]?(\d{4})[ -]?(\d{5})[ -]?(\d{2})[ -]?(\d)\b", lambda s, m: (11 - weigh(s, range(13, 1, -1)) % 11) % 10 == int(s[12]), "thai-mod11")
number("national-id-sg-nric", N, "SG", r"\b([STFGM])(\d{7})([A-Z])\b", lambda s, m: {"S": "JZIHGFEDCBA", "T": "JZIHGFEDCBA", "F": "XWUTRQPNMLK", "G": "XWUTRQPNMLK", "M": "KLJNPQRTUWX"}[m[1]][(weigh(m[2], (2, 7, 6, 5, 4, 3, 2)) + {"T": 4, "G": 4, "M": 3}.get(m[1], 0)) % 11] == m[3] if m[1] != "M" else "KLJNPQRTUWX"[10 - (weigh(m[2], (2, 7, 6, 5, 4, 3, 2)) + 3) % 11] == m[3], "nric-mod11")
number("national-id-au-tfn", T, "AU", r"\b(\d{3})[ ]?(\d{3})[ ]?(\d{3})\b", lambda s, m: weigh(s, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0, "tfn-mod11")
number("national-id-au-abn", T, "AU", r"\b(\d{2})[ ]?(\d{3})[ ]?(\d{3})[ ]?(\d{3})\b", lambda s, m: weigh(str(int(s[0]) - 1) + s[1:], (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)) % 89 == 0 and s[0] != "0", "abn-mod89")
number("national-id-au-medicare", N, "AU", r"\b([2-6]\d{3})[ ]?(\d{5})[ ]?(\d)(?:[ ]?(\d))?\b", lambda s, m: weigh(s, (1, 3, 7, 9, 1, 3, 7, 9)) % 10 == int(s[8]), "medicare-mod10")
number("national-id-br-cpf", N, "BR", r"\b(\d{3})\.?(\d{3})\.?(\d{3})-?(\d{2})\b", lambda s, m: not repeated(s) and all(weigh(s, range(k, 1, -1)) * 10 % 11 % 10 == int(s[k - 1]) for k in (10, 11)), "cpf-dual-mod11")
number("national-id-br-cnpj", T, "BR", r"\b(\d{2})\.?(\d{3})\.?(\d{3})/?(\d{4})-?(\d{2})\b", lambda s, m: not repeated(s) and complement11((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), s) and complement11((6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), s), "cnpj-dual-mod11")
number("national-id-ar-cuit", T, "AR", r"\b(\d{2})-(\d{8})-(\d)\b", lambda s, m: (11 - weigh(s, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11) % 11 == int(s[10]), "cuit-mod11")
number("national-id-cl-rut", N, "CL", r"\b(\d{1,2}(?:\.\d{3}){2}|\d{7,8})-([\dKk])\b", lambda s, m: "0123456789K"[(11 - weigh(s[-2::-1], (2, 3, 4, 5, 6, 7) * 2) % 11) % 11] == s[-1].upper(), "rut-mod11")
number("national-id-co-nit", T, "CO", r"\b(\d{1,3}(?:\.\d{3}){2,3}|\d{8,10})-(\d)\b", lambda s, m: (r if (r := weigh(s[-2::-1], (3, 7, 13, 17, 19, 23, 29, 37, 41, 43, 47, 53, 59, 67, 71)) % 11) < 2 else 11 - r) == int(s[-1]), "nit-mod11")
number("national-id-pe-dni", N, "PE", r"\bDNI(?:\s*(?:N[°º.]?|No\.?))?:?\s*(\d{8})\b", lambda s, m: True, "dni-labeled", MEDIUM, 1)
number("national-id-ng-nin", N, "NG", r"\bNIN:?\s*(\d{11})\b", lambda s, m: True, "nin-labeled", MEDIUM, 1)
number("national-id-ke", N, "KE", r"\bID\s?(?:No\.?|Number):?\s*(\d{8})\b", lambda s, m: True, "ke-id-labeled", MEDIUM, 1)
number("national-id-ma-cnie", N, "MA", r"\b(?:CNIE|CIN):?\s*([A-Z]{1,2}\d{6})\b", lambda s, m: True, "cnie-labeled", MEDIUM, 1)
number("national-id-pk-cnic", N, "PK", r"\b([1-9]\d{4})-(\d{7})-(\d)\b", lambda s, m: True, "cnic-structure", MEDIUM)
number("national-id-my-mykad", N, "MY", r"\b(\d{2})(\d{2})(\d{2})-(\d{2})-(\d{4})\b", lambda s, m: day(m[3], m[2]), "mykad-structure", MEDIUM)
number("national-id-ph-psn", N, "PH", r"\b(\d{4})-(\d{4})-(\d{4})-(\d{4})\b", lambda s, m: True, "psn-structure", MEDIUM)
