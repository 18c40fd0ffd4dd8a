"""Surrogates: replacements that look like the original and pass the same detector's checks, and masking with them.

A surrogate keeps the shape (digits stay digits, letters keep their case) and what says country, issuer or provider; the
rest is drawn at random from a seeded generator until the detector's own validator accepts it. So every detector of the
catalogue has surrogates without a generator of its own; values whose checks can't be met by drawing are built.
"""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from veilframe.functions.keccak import keccak256
from veilframe.operators import catalog_more  # noqa: F401  registers more detectors
from veilframe.operators.catalog import B58, B62, CATALOG, PROVIDERS, base58check, zlib

TRIES, ATTEMPTS = 5000, 24
#: Characters at the beginning that stay, by type.
KEPT = {"IBAN": 2, "VAT_NUMBER": 2, "CREDIT_CARD": 4, "SWIFT_BIC": 6, "US_NPI": 1, "PHONE": 3}
NAMES = "alex robin kim sam chris jamie taylor morgan casey jordan riley avery quinn rowan".split()
WORDS = "amber birch cedar delta ember fjord grove harbor inlet juniper linden maple".split()


def shaped(text: str, kept: int, rng: random.Random) -> str:
    draw = lambda c: rng.choice("0123456789") if c.isdigit() else rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if "A" <= c <= "Z" else rng.choice("abcdefghijklmnopqrstuvwxyz") if "a" <= c <= "z" else c
    return text[:kept] + "".join(map(draw, text[kept:]))


def to_base58check(raw: bytes) -> str:
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = B58[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def wallet(text: str, rng: random.Random) -> str | None:
    """Wallets with a checksum of their own: base58check with the same version, and mixed-case hexadecimal."""
    if text.startswith("0x"):
        low = rng.randbytes(20).hex()
        return "0x" + "".join(c.upper() if int(h, 16) > 7 else c for c, h in zip(low, keccak256(low.encode()).hex()))
    raw = base58check(text)
    return to_base58check(raw[:1] + rng.randbytes(len(raw) - 1)) if raw else None


def key_of_provider(text: str, rng: random.Random) -> str:
    prefix = next((p for p in sorted(PROVIDERS, key=len, reverse=True) if text.startswith(p)), "")
    out = shaped(text, len(prefix), rng)
    if re.fullmatch(r"gh[pousr]_", prefix):
        n, tail = zlib.crc32(out[len(prefix) : -6].encode()), ""
        for _ in range(6):
            n, r = divmod(n, 62)
            tail = B62[r] + tail
        out = out[:-6] + tail
    return out


def surrogate(kind: str, detector_id: str, text: str, rng: random.Random) -> str | None:
    """A replacement, or None where a token must do."""
    spec = CATALOG.get(detector_id)
    if kind in ("PASSPORT_MRZ", "PRIVATE_KEY", "JWT", "URL_WITH_CREDENTIALS", "CONNECTION_STRING", "HEALTH_DATA") or spec is None:
        return None
    accepts = lambda s: any(m.span() == (0, len(s)) and (v := spec.validate(m)) and v.sensitive for m in re.finditer(spec.pattern, s, spec.flags))
    if kind == "EMAIL":
        return f"{rng.choice(NAMES)}.{rng.choice(WORDS)}{rng.randrange(10, 10000)}@{rng.choice(WORDS)}{rng.randrange(10, 1000)}.net"
    if kind == "STREET_ADDRESS":
        return shaped(text, 0, rng) if not accepts(text) else re.sub(r"\d", lambda _: rng.choice("123456789"), text)
    if kind == "IP_ADDRESS" and ":" in text:
        return ":".join(["2a02", *(f"{rng.randrange(1, 65536):x}" for _ in range(7))])
    if kind == "CRYPTO_WALLET" and (text.startswith("0x") or base58check(text)):
        made = wallet(text, rng)
        return made if made and accepts(made) else None
    if kind == "API_KEY":
        made = key_of_provider(text, rng)
        return made if accepts(made) else None
    needs_label = not accepts(text)
    for _ in range(TRIES):
        made = shaped(text, KEPT.get(kind, 0), rng)
        if needs_label or accepts(made):
            return made
    return None


def replaced(text: str, entities: list[dict], seed: int = 0) -> list[dict]:
    """The spans with replacements: one per distinct value, valid, new to the text and to each other; else a token.

    The same value of a type has the same surrogate under one seed, in every document where no collision forbids it.
    """
    low, taken, known, counts = text.lower(), set(), {}, {}
    values = [(e["canonical"] or e["text"]).lower() for e in entities]
    plain = [p for v in values if len(p := re.sub(r"[ \t./-]", "", v)) >= 6]
    out = []
    for e in sorted(entities, key=lambda e: e["start"]):
        value = e["canonical"] or e["text"]
        found = known.get((e["type"], value))
        for attempt in range(0 if found else ATTEMPTS):
            rng = random.Random(f"{seed}:{e['type']}:{value}:{attempt}")
            made = surrogate(e["type"], e["detector_id"], e["text"], rng)
            if made is None:
                break
            bare = re.sub(r"[ \t./-]", "", made.lower())
            if made.lower() not in low and made not in taken and not any(v in made.lower() for v in values) and not any(p in bare for p in plain) and not any(made in t or t in made for t in taken):
                found = made
                break
        if not found:
            counts[e["type"]] = counts.get(e["type"], 0) + 1
            found = f"[{e['type']}_{counts[e['type']]}]"
        known[(e["type"], value)] = found
        taken.add(found)
        out.append({"start": e["start"], "end": e["end"], "type": e["type"], "value": value, "original": e["text"], "token": found})
    return out


def with_surrogates(df: DataFrame, text: str = "text", entities: str = "entities", seed: int = 0) -> DataFrame:
    """df with tokens, as masking.with_tokens gives them, but with surrogates; no shuffle. A null text has none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string("array<struct<start: int, end: int, type: string, value: string, original: string, token: string>>")
    schema = StructType([*[f for f in df.schema.fields if f.name != "tokens"], StructField("tokens", kind)])
    arrow = to_arrow_schema(StructType([schema["tokens"]])).field(0).type
    rest = df.select(*[f.name for f in schema.fields[:-1]])
    t_at, e_at = rest.columns.index(text), rest.columns.index(entities)

    def run(batches):
        for b in batches:
            found = [replaced(t, e, seed) if t and e else [] for t, e in zip(b.column(t_at).to_pylist(), b.column(e_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, type=arrow)], names=[*b.schema.names, "tokens"])

    return rest.mapInArrow(run, schema)
