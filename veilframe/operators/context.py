"""Evidence around candidates: structure slots, trigger words, format, negative rules, and the additive confidence.

Everything is per document and per candidate's line or window, so it runs inside the scan's kernel, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from veilframe.functions.text import fold_for_match

#: Words that vouch for a type; a larger lexicon is a parameter.
LEXICON = {
    "NATIONAL_ID": "ssn, social security, national id, id number, identity number, ausweis, personalausweis, numero de securite sociale, dni, nif, cedula, passport number, aadhaar, pesel, cpf, tckn, nhs number, insurance number",
    "TAX_ID": "tax id, tin, ein, itin, steuer id, steuernummer, numero fiscal, cif, nip, inn, abn, tfn, taxpayer",
    "VAT_NUMBER": "vat, vat number, ust id, umsatzsteuer, tva, iva, btw",
    "CREDIT_CARD": "card, card number, credit card, kreditkarte, carte bancaire, tarjeta, pan",
    "IBAN": "iban, account, konto, compte, cuenta",
    "SWIFT_BIC": "bic, swift",
    "US_ROUTING_NUMBER": "routing, aba, routing number",
    "UK_SORT_CODE": "sort code",
    "PHONE": "phone, tel, telephone, telefon, mobile, handy, telefono, fax",
    "EMAIL": "email, e-mail, mail, courriel, correo",
    "POSTAL_CODE": "zip, zip code, postcode, postal code, plz, code postal, codigo postal",
    "STREET_ADDRESS": "address, street, adresse, anschrift, direccion, domicilio",
    "HEALTH_DATA": "diagnosis, icd, snomed, patient, diagnose, diagnostic, lab",
    "DRIVERS_LICENSE": "driver licence, driver license, driving licence, fuhrerschein, permis de conduire, licencia de conducir",
    "API_KEY": "api key, apikey, api_key, access key, key",
    "GENERIC_SECRET": "secret, token, password, passwd, passwort, mot de passe, contrasena, api key, api_key, client_secret, credential, auth",
    "CRYPTO_WALLET": "wallet, address, bitcoin, ethereum, monero",
    "VIN": "vin, chassis, fahrgestellnummer",
    "US_NPI": "npi, provider",
}
CONTACTS = {"EMAIL", "PHONE", "STREET_ADDRESS", "POSTAL_CODE", "PERSON", "LOCATION", "DATE_OF_BIRTH", "NATIONAL_ID"}
CONTACT_GAP, WINDOW, CLOSE = 240, 64, 16
NAMED, ASSIGNED, TRIGGER_CLOSE, TRIGGER_FAR, CONTACT_RECORD, REPEATED = 0.35, 0.05, 0.25, 0.10, 0.10, -0.20
# What a document's format adds to types.
FORMAT_DELTAS = {
    "code": {"GENERIC_SECRET": 0.10, "API_KEY": 0.05, "PRIVATE_KEY": 0.05, "PERSON": -0.15, "ORG": -0.10, "LOCATION": -0.10},
    "log": {"GENERIC_SECRET": 0.05, "PERSON": -0.10, "ORG": -0.05, "LOCATION": -0.05},
    "json": {"GENERIC_SECRET": 0.05, "PERSON": -0.05},
    "yaml": {"GENERIC_SECRET": 0.05, "PERSON": -0.05},
    "email": {"PERSON": 0.05, "PHONE": 0.05},
}

@dataclass(frozen=True)
class Slot:
    key: str
    kind: str
    start: int
    end: int


MOST_KEY, MOST_WIDE_KEY = 48, 24
QUOTES = "\"'`"
DECLARES = {"const", "let", "var", "val", "my", "final", "String"}
VERBS = ("set", "with", "put", "add", "update")


def skip(line: str, at: int, step: int) -> int:
    """The first place from at on, in steps of 1 or -1, that holds no blank."""
    while 0 <= at < len(line) and line[at] in " \t":
        at += step
    return at


def is_name(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "_$.-")


def name_before(line: str, at: int) -> tuple[int, int]:
    """The span of the name that ends before at, blanks passed over; empty where there is none."""
    end = skip(line, at - 1, -1) + 1
    start = end
    while start and is_name(line[start - 1]):
        start -= 1
    return start, end


def value_after(line: str, at: int, stops: str) -> tuple[int, int]:
    """The span of the value from at on: within quotes, or up to one of the stops."""
    a = skip(line, at, 1)
    if a < len(line) and line[a] in QUOTES and (close := line.find(line[a], a + 1)) > 0:
        return a + 1, close
    b = a
    while b < len(line) and line[b] not in stops:
        b += 1
    return a, b


def tidied(line: str, a: int, b: int) -> tuple[int, int]:
    """A span without trailing separators, and without the quotes around all of it."""
    while a < b and line[b - 1] in " \t\r,;":
        b -= 1
    return (a + 1, b - 1) if b - a > 1 and line[a] in QUOTES and line[b - 1] == line[a] else (a, b)


def at_equals(line: str, i: int) -> tuple[str, str, int, int] | None:
    """(kind, key, start, end) of what an equals sign assigns: options, declarations, and lines of name and value."""
    if line[i + 1 : i + 2] in ("=", ">") or i and line[i - 1] in "=!<>":
        return None
    a, b = name_before(line, i)
    before = line[:a].rstrip()
    if before.endswith(":"):  # a declared type stands between
        a, b = name_before(line, len(before) - 1)
        before = line[:a].rstrip()
    key = line[a:b].lstrip("-")
    if not key or len(key) > MOST_KEY or not (key[0].isalpha() or key[0] in "_$"):
        return None
    if line[a:b].startswith("--") and b == i and line[a - 1 : a] in ("", " ", "\t"):
        return ("flag", key, *value_after(line, i + 1, " \t"))
    if before.split(" ")[-1] in DECLARES:
        return ("assignment", key, *value_after(line, i + 1, " \t;"))
    if before.strip() in ("", "export"):
        return ("env", key, skip(line, i + 1, 1), len(line))
    return None


def at_colon(line: str, i: int) -> tuple[str, str, int, int] | None:
    """What a colon assigns: quoted keys, header texts within quotes, labels that begin a line, labels without blanks beyond ASCII."""
    end = skip(line, i - 1, -1)
    spaced = line[i + 1 : i + 2] in (" ", "\t")
    if line[i] == ":" and end > 0 and line[end] in QUOTES:
        start = line.rfind(line[end], 0, end)
        if 0 <= start and 0 < end - start - 1 <= MOST_KEY:
            return ("json", line[start + 1 : end], *value_after(line, i + 1, ",}]"))
        return None
    if line[i] == ":" and spaced:
        for q in "\"'":
            start = line.rfind(q, 0, i)
            inside = line[start + 1 : i].strip()
            if start >= 0 and line.count(q, 0, i) % 2 and 0 < len(inside) <= MOST_KEY and inside[0].isalpha() and inside.replace("-", "").isalnum() and inside.isascii():
                close = line.find(q, i)
                return ("header", inside, skip(line, i + 1, 1), close if close > 0 else len(line))
        label = line[:i].lstrip(" \t>*-").rstrip()
        if 0 < len(label) <= MOST_KEY and label[0].isalpha() and not set(label) & set(":{}\"'`"):
            return ("colon", label, skip(line, i + 1, 1), len(line))
    start = end + 1
    while start and not line[start - 1].isascii() and not line[start - 1].isspace() and line[start - 1] != "：":
        start -= 1
    if 0 < end + 1 - start <= MOST_WIDE_KEY:
        return ("wide-colon", line[start : end + 1], *value_after(line, i + 1, " \t\r"))
    return None


def at_call(line: str, i: int) -> tuple[str, str, int, int] | None:
    """What a call with a quoted first argument sets; a verb that begins the name is left out of the key."""
    a, b = name_before(line, i)
    name = line[a:b].rpartition(".")[2]
    quote = skip(line, i + 1, 1)
    if not name or len(name) > MOST_KEY + 6 or not (name[0].isalpha() or name[0] in "_$") or line[quote : quote + 1] not in ("'", '"'):
        return None
    close = line.find(line[quote], quote + 1)
    if close < 0 or line[skip(line, close + 1, 1) : skip(line, close + 1, 1) + 1] not in (",", ")"):
        return None
    verb = next((v for v in VERBS if name.startswith(v) and len(name) > len(v)), "")
    return ("call", name[len(verb) :], quote + 1, close)


SIGNS = {"=": at_equals, ":": at_colon, "：": at_colon, "(": at_call}


def line_slots(line: str, at: int) -> list[Slot]:
    """Key and value pairs of one line that begins at `at`: what each sign of the line assigns."""
    out = []
    for i, c in enumerate(line):
        if c in SIGNS and (found := SIGNS[c](line, i)):
            kind, key, *span = found
            a, b = tidied(line, *span)
            if a < b:
                out.append(Slot(key.strip(), kind, at + a, at + b))
    return out


def cells(line: str, separator: str) -> list[tuple[int, int]]:
    """Spans of a row's cells; separators within double quotes don't count."""
    out, start, quoted = [], 0, False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == separator and not quoted:
            out.append((start, i))
            start = i + 1
    return [*out, (start, len(line))]


def table_slots(lines: list[tuple[int, str]]) -> list[Slot]:
    """Cells of Markdown tables and of texts that are a CSV table as a whole, keyed by their header."""
    out: list[Slot] = []

    def add(kind: str, separator: str, rows: list[tuple[int, str]]) -> None:
        names = [rows[0][1][a:b].strip(' "') for a, b in cells(rows[0][1], separator)]
        for at, row in rows[1:]:
            for name, (a, b) in zip(names, cells(row, separator)):
                value = row[a:b].strip(' "')
                if name and value and len(name) <= 48:
                    first = at + row.index(value, a)
                    out.append(Slot(name, kind, first, first + len(value)))

    block: list[tuple[int, str]] = []
    for at, row in [*lines, (0, "")]:
        if row.count("|") >= 2:
            if not re.fullmatch(r"[\s|:-]+", row):
                block.append((at, row))
        else:
            if len(block) > 1:
                add("markdown-table", "|", block)
            block = []
    filled = [(at, row) for at, row in lines if row.strip()]
    widths = {len(cells(row, ",")) for _, row in filled}
    if len(filled) >= 2 and len(widths) == 1 and widths.pop() >= 2:
        add("csv", ",", filled)
    return out


def structure_index(text: str) -> list[Slot]:
    """All slots of a text; in a diff, line markers are not read."""
    is_diff = bool(re.search(r"^(?:@@ -\d+|--- a/|\+\+\+ b/|diff --git )", text, re.M))
    lines, at, out, block = [], 0, [], None
    for line in text.split("\n"):
        shift = 1 if is_diff and line[:1] in ("+", "-", " ") else 0
        lines.append((at + shift, line[shift:]))
        opened = re.fullmatch(r"(\s*)([\w.-]{1,48})\s*:\s*[|>][+-]?\d*\s*", line)
        if block and line.strip() and len(line) - len(line.lstrip()) > block[1]:
            body = line.strip()
            out.append(Slot(block[0], "block-scalar", at + line.index(body), at + line.index(body) + len(body)))
        elif opened:
            block = (opened[2], len(opened[1]))
        elif line.strip():
            block = None
        at += len(line) + 1
    if re.search(r"^\s*machine\s+\S+", text, re.M):
        out += [Slot(m[1], "netrc", *m.span(2)) for m in re.finditer(r"\b(login|password|account)\s+(\S+)", text)]
    for start, line in lines:
        out += line_slots(line, start)
    return out + table_slots(lines)


def line_of(text: str, at: int) -> int:
    """Where the line of a position begins."""
    return text.rfind("\n", 0, at) + 1


def slots_by_line(text: str) -> dict[int, list[Slot]]:
    out: dict[int, list[Slot]] = {}
    for s in structure_index(text):
        out.setdefault(line_of(text, s.start), []).append(s)
    return out


def slot_at(by_line: dict[int, list[Slot]], line: int, start: int, end: int) -> Slot | None:
    """The narrowest slot of the line that holds the span, the earliest on ties."""
    return min((s for s in by_line.get(line, ()) if s.start <= start and end <= s.end), key=lambda s: (s.end - s.start, s.start), default=None)


class Around:
    """Candidates in order of start, to look up those near a span without passing over all."""

    def __init__(self, candidates: list[dict]):
        self.ordered = sorted(candidates, key=lambda c: c["start"])
        self.starts = [c["start"] for c in self.ordered]
        self.longest = max((c["end"] - c["start"] for c in candidates), default=0)

    def within(self, start: int, end: int, gap: int):
        for k in range(bisect_left(self.starts, start - gap - self.longest), len(self.starts)):
            c = self.ordered[k]
            if c["start"] - end > gap:
                return
            if start - c["end"] <= gap:
                yield c


def same_length_fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c.lower() if c.isascii() else f if len(f := fold_for_match(c)) == 1 else c for c in text)


def folded_key(key: str) -> str:
    """accessToken, ACCESS_TOKEN and access-token as "access token"."""
    return re.sub(r"[\s_.-]+", " ", same_length_fold(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", key))).strip()


class Triggers:
    """Lexicon terms: those of scripts with spaces as whole words, others as substrings, longest first."""

    UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")

    def __init__(self, lexicon: dict[str, str | list[str]]):
        self.types: dict[str, set[str]] = {}
        for kind, terms in lexicon.items():
            for term in terms.split(",") if isinstance(terms, str) else terms:
                self.types.setdefault(folded_key(term), set()).add(kind)
        ordered = sorted(self.types, key=len, reverse=True)
        word = lambda t: re.escape(t).replace(r"\ ", r"[\s_.-]+")
        parts = [word(t) if self.UNSPACED.search(t) else rf"(?<!\w){word(t)}(?!\w)" for t in ordered]
        self.pattern = re.compile("|".join(parts)) if parts else None

    def find(self, folded: str) -> list[tuple[int, int, str]]:
        return [(m.start(), m.end(), folded_key(m[0])) for m in self.pattern.finditer(folded)] if self.pattern else []

    def near(self, found: list[tuple[int, int, str]], start: int, end: int, window: int = WINDOW) -> list[tuple[int, str]]:
        """(distance, term) within the window on either side, nearest first."""
        out = []
        for k in range(bisect_left(found, (start - 2 * window, 0, "")), len(found)):
            a, b, term = found[k]
            if a > end + window:
                break
            gap = start - b if b <= start else a - end
            if 0 <= gap <= window:
                out.append((gap, term))
        return sorted(out)


NUMERIC = "POSTAL_CODE NATIONAL_ID TAX_ID DRIVERS_LICENSE HEALTH_DATA US_ROUTING_NUMBER US_NPI CREDIT_CARD PHONE".split()
UNITS = set("mg g kg ml l dl mmol iu u ng pg % bpm mmhg µg µiu miu fl meq".split())
#: Words that make an example of what follows, and nouns that number things.
EXAMPLES = ("e.g.", "for example", "for instance", "example", "sample", "such as", "z.b.", "z. b.", "zum beispiel", "beispiel", "par exemple", "por ejemplo", "ejemplo", "per esempio", "esempio", "bijvoorbeeld", "np.", "örneğin", "например", "例如")
NUMBERED = set("order invoice ticket case issue item page chapter section figure table batch version build receipt shipment tracking reference serial part model room bestellung rechnung auftrag artikel seite kapitel commande facture numéro article pedido factura artículo ordine fattura articolo encomenda fatura bestelling factuur zamówienie faktura sipariş fatura заказ счёт".split())
NUMBER_WORDS = set("no nr number id num nummer numéro número numero №".split())
REACH = 60


def framed_as_example(line: str, at: int) -> bool:
    """An example word stands in the REACH characters before a place, and no clause ends between."""
    before = line[max(0, at - REACH - 20) : at].lower()
    for word in EXAMPLES:
        k = before.rfind(word)
        if k >= 0 and (k == 0 or not before[k - 1].isalnum()):
            between = before[k + len(word) :]
            if len(between) <= REACH and not set(between) & set(".;!?\n"):
                return True
    return False


def numbered_label(line: str, at: int) -> bool:
    """The words right before a place are a noun that numbers things, and perhaps a word for number."""
    words = line[max(0, at - 60) : at].lower().replace("#", " ").replace(":", " ").replace(".", " ").replace("-", " ").replace("°", " ").split()
    while words and words[-1] in NUMBER_WORDS:
        words.pop()
    return bool(words) and words[-1] in NUMBERED


def token_around(line: str, a: int, b: int) -> str:
    word = lambda c: c.isalnum() or c in "_.+-"
    while a and word(line[a - 1]):
        a -= 1
    while b < len(line) and word(line[b]):
        b += 1
    return line[a:b]


def is_version(line: str, a: int, b: int) -> bool:
    """The span is a part of v1.2, of three dotted numbers or more, or of a pre-release."""
    token = token_around(line, a, b)
    if token == line[a:b]:
        return False
    body, _, tag = token.partition("-")
    marked = body[:1] in ("v", "V")
    numbers = body[marked:].split(".")
    if not all(x.isdigit() for x in numbers):
        return False
    return marked or len(numbers) >= 3 or tag.startswith(("rc", "beta", "alpha"))


PHONE_SIGNS = set("0123456789 ()./-")


def in_phone(line: str, a: int, b: int) -> bool:
    """The span is within a run of phone signs that begins with + and a digit and has 8 to 15 digits."""
    start, end = a, b
    while start and line[start - 1] in PHONE_SIGNS:
        start -= 1
    while end < len(line) and line[end] in PHONE_SIGNS:
        end += 1
    return start < a and start > 0 and line[start - 1] == "+" and line[start].isdigit() and 8 <= sum(c.isdigit() for c in line[start:end]) <= 15


def in_authority(line: str, a: int, b: int) -> bool:
    """The span is in the part of a URI between :// and the path."""
    k = line.rfind("://", 0, a)
    return k > 0 and line[k - 1].isalnum() and not set(line[k + 3 : a]) & set(" \t/?#")


def is_port(line: str, a: int, b: int) -> bool:
    host = token_around(line, a - 1, a - 1) if a > 1 and line[a - 1] == ":" else ""
    name, dot, top = host.rpartition(".")
    return bool(dot and name) and len(top) >= 2 and top.isalpha() and line[a:b].isdigit() and int(line[a:b]) <= 65535


def in_measured_range(line: str, a: int, b: int) -> bool:
    """The span is within brackets that follow a number with a unit."""
    k = max(line.rfind("[", 0, a), line.rfind("(", 0, a))
    if k < 0 or set(line[k + 1 : a]) & set("])"):
        return False
    words = line[:k].lower().split()
    unit = words[-1].lstrip("0123456789.,") if words else ""
    measured = words and (words[-1][0].isdigit() or len(words) > 1 and words[-2][-1].isdigit())
    return bool(measured) and unit.split("/")[0] in UNITS


def beside_digits(line: str, a: int, b: int, before: str, after: str) -> bool:
    """A digit stands beyond one of the signs before or after the span."""
    return b + 1 < len(line) and line[b] in after and line[b + 1].isdigit() or a > 1 and line[a - 1] in before and line[a - 2].isdigit()


def in_data_uri(line: str, a: int, b: int) -> bool:
    k = line.rfind(";base64,", 0, a)
    return k >= 0 and all(c.isascii() and (c.isalnum() or c in "+/=") for c in line[k + 8 : a])


def beside_degrees(line: str, a: int, b: int) -> bool:
    return "<<<" in line[max(0, a - 40) : b + 40] or line[b : b + 1] in tuple("°′″") or a > 0 and line[a - 1] in "°′″"


#: (rule, types, delta or None to suppress, predicate over the candidate's line); the first suppressing rule ends the list.
NEGATIVE = [
    ("phone-run-interior", [t for t in NUMERIC if t != "PHONE"], None, in_phone),
    ("uri-authority", "EMAIL POSTAL_CODE NATIONAL_ID TAX_ID DRIVERS_LICENSE".split(), None, in_authority),
    ("host-port", ["POSTAL_CODE"], None, is_port),
    ("bracketed-numeric-range", "POSTAL_CODE NATIONAL_ID TAX_ID".split(), None, in_measured_range),
    ("version-number", NUMERIC, None, is_version),
    ("fragment-boundary", "POSTAL_CODE DRIVERS_LICENSE HEALTH_DATA".split(), None, lambda s, a, b: beside_digits(s, a, b, ":/", "/:.")),
    ("digit-group-run-member", ["POSTAL_CODE"], None, lambda s, a, b: beside_digits(s, a, b, " -", " -")),
    ("notation-delimiter", "POSTAL_CODE SWIFT_BIC NATIONAL_ID TAX_ID".split(), None, beside_degrees),
    ("data-uri-payload", ["GENERIC_SECRET"], None, in_data_uri),
    ("uninformative-key-body", ["API_KEY"], None, lambda s, a, b: len(set(s[a:b].replace("-", "_").rpartition("_")[2])) == 1),
    ("enumeration-label", "NATIONAL_ID TAX_ID HEALTH_DATA US_ROUTING_NUMBER US_NPI".split(), -0.20, lambda s, a, b: numbered_label(s, a)),
    ("example-frame", "POSTAL_CODE DRIVERS_LICENSE".split(), None, lambda s, a, b: framed_as_example(s, a)),
    ("example-frame-validated", "NATIONAL_ID TAX_ID CREDIT_CARD IBAN API_KEY GENERIC_SECRET".split(), -0.25, lambda s, a, b: framed_as_example(s, a)),
]


def format_of(text: str) -> str:
    """The format that most lines speak for; prose where none does."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return "unknown"
    share = lambda p: sum(bool(re.search(p, x)) for x in lines) / len(lines)
    headers = sum(bool(re.match(r"(?:From|To|Subject|Date|Cc): ", x)) for x in lines)
    scores = {
        "markdown-table": 2.5 + r if (r := share(r"^\s*\|.*\|\s*$")) >= 0.5 else 0,
        "json": 2 * bool(re.fullmatch(r"\s*[{\[].*[}\]]\s*", text, re.S)) + (2 + r if (r := share(r'^\s*[{\[]*\s*"[^"]+"\s*:')) >= 0.34 else 0),
        "yaml": 1.5 + r if (r := share(r"^\s*(?:- )?[\w-]+:(?:\s|$)")) >= 0.5 else 0,
        "log": 1 + 1.5 + r if (r := share(r"^\[?\d{4}-\d\d-\d\d[T ]\d\d:")) >= 0.5 else 0,
        "code": 1 + 2 * r if (r := share(r"[;{}]\s*$|^\s*(?:def|class|import|from|function|const|let|var|return|if|for)\b.*[:;({=]")) >= 0.25 else 0,
        "email": 2 + 0.2 * headers if headers >= 2 else 0,
    }
    best = max(scores, key=scores.get)
    return best if scores[best] > 0 else "prose"


def scored(text: str, candidates: list[dict], triggers: Triggers, explain: bool = True) -> list[dict]:
    """Candidates with the context confidence as raw_conf; metadata has the signals. A suppressed one has 0.

    A candidate that needs context keeps its cap of detection unless a slot or a trigger of any type is near; that is
    settled by detect.scan through near_any.
    """
    if not candidates:
        return candidates
    found, slots, kind = triggers.find(same_length_fold(text)), slots_by_line(text), format_of(text)
    everyone, contacts = Around(candidates), Around([c for c in candidates if c["type"] in CONTACTS])
    out = []
    for c in candidates:
        a, b, t = c["start"], c["end"], c["type"]
        signals: list[tuple[str, float]] = []
        line_at = line_of(text, a)
        line = text[line_at : e if (e := text.find("\n", b)) >= 0 else len(text)]
        slot, near = slot_at(slots, line_at, a, b), triggers.near(found, a, b)
        suppressed = None
        if slot:
            names = t in triggers.types.get(folded_key(slot.key), ())
            signals.append((f"structure:key-names-{t}", NAMED) if names else (f"structure:{slot.kind}", ASSIGNED))
        mine = next((gap for gap, term in near if t in triggers.types[term]), None)
        if mine is not None:
            signals.append(("trigger", TRIGGER_CLOSE if mine <= CLOSE else TRIGGER_FAR))
        if t in FORMAT_DELTAS.get(kind, {}):
            signals.append((f"format:{kind}", FORMAT_DELTAS[kind][t]))
        if t in CONTACTS:
            if len({o["type"] for o in contacts.within(a, b, CONTACT_GAP)} - {t}) >= 2:
                signals.append(("contact-record", CONTACT_RECORD))
        if t in ("PERSON", "ORG", "LOCATION") and kind in ("code", "log", "json", "yaml", "csv") and text.count(c["text"]) >= 4:
            signals.append(("repetition", REPEATED))
        for rule, types, delta, test in NEGATIVE:
            if t in types and test(line, a - line_at, b - line_at):
                signals.append((f"negative:{rule}", -1.0 if delta is None else delta))
                if delta is None:
                    suppressed = rule
                    break
        if t == "GENERIC_SECRET" and not suppressed and (slot is None and not near or any(o["type"] != t for o in everyone.within(a, b, -1))):
            suppressed = "unexplained-secret"
        conf = 0.0 if suppressed else min(1.0, max(0.0, c["raw_conf"] + sum(d for _, d in signals)))
        more = {"signals": ", ".join(f"{s} {d:+.2f}" for s, d in signals)} if explain and signals else {}
        out.append(c | {"raw_conf": conf, "metadata": c["metadata"] | more | ({"suppressed": suppressed} if suppressed else {})})
    return out


def near_any(text: str, triggers: Triggers):
    """near(start, end): a slot holds the span or any trigger is near it; looked up only when first asked."""
    cache: list = []

    def near(start: int, end: int) -> bool:
        if not cache:
            cache.append((triggers.find(same_length_fold(text)), slots_by_line(text)))
        found, slots = cache[0]
        return bool(triggers.near(found, start, end)) or slot_at(slots, line_of(text, start), start, end) is not None

    return near


def slot_spans(text: Column) -> Column:
    """The slots of a text column, an array of (key, kind, start, end); only the texts go to Python. A null text has none."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = "array<struct<key: string, kind: string, start: int, end: int>>"
    arrow = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[vars(s) for s in structure_index(t)] if t else [] for t in texts.to_pylist()], type=arrow)

    return found(text)


def with_slots(df: DataFrame, text: str = "text") -> DataFrame:
    """df with slots; replaces a column of that name."""
    return df.withColumn("slots", slot_spans(F.col(text)))
