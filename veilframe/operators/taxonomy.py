"""Entity types with family, severity category, weights and specificity; profiles and their thresholds."""

from __future__ import annotations

# Severity category of each type, category weights, factors of types, specificity (0 is most specific).
CATEGORY = {
    "government-identity": "NATIONAL_ID TAX_ID PASSPORT_MRZ DRIVERS_LICENSE VIN US_NPI".split(),
    "health": "HEALTH_DATA".split(),
    "financial": "CREDIT_CARD IBAN SWIFT_BIC CRYPTO_WALLET VAT_NUMBER US_ROUTING_NUMBER UK_SORT_CODE CA_TRANSIT_NUMBER AU_BSB IN_IFSC BR_AGENCIA".split(),
    "secrets": "API_KEY JWT PRIVATE_KEY CONNECTION_STRING URL_WITH_CREDENTIALS GENERIC_SECRET".split(),
    "contact": "EMAIL PHONE IP_ADDRESS MAC_ADDRESS".split(),
    "personal-names": "PERSON ORG".split(),
    "location": "STREET_ADDRESS POSTAL_CODE COORDINATES LOCATION".split(),
}
WEIGHT = {"government-identity": 100, "health": 90, "financial": 75, "secrets": 70, "contact": 45, "personal-names": 35, "location": 25}
FACTOR = {"STREET_ADDRESS": 1.6, "POSTAL_CODE": 0.8, "COORDINATES": 1.6, "PRIVATE_KEY": 1.3, "GENERIC_SECRET": 0.7, "PASSPORT_MRZ": 1.0, "DRIVERS_LICENSE": 0.9, "VIN": 0.5, "ORG": 0.6}
RANKS = [
    "PASSPORT_MRZ PRIVATE_KEY JWT", "CONNECTION_STRING", "URL_WITH_CREDENTIALS",
    "IBAN CREDIT_CARD CRYPTO_WALLET API_KEY VAT_NUMBER US_NPI VIN SWIFT_BIC US_ROUTING_NUMBER UK_SORT_CODE CA_TRANSIT_NUMBER AU_BSB IN_IFSC BR_AGENCIA",
    "EMAIL PHONE IP_ADDRESS MAC_ADDRESS COORDINATES STREET_ADDRESS", "HEALTH_DATA", "NATIONAL_ID TAX_ID", "PERSON ORG LOCATION",
    "POSTAL_CODE DRIVERS_LICENSE DATE_OF_BIRTH", "GENERIC_SECRET",
]
CATEGORY_OF = {t: c for c, ts in CATEGORY.items() for t in ts}
SPECIFICITY = {t: i for i, ts in enumerate(RANKS) for t in ts.split()}
EAGER = ("API_KEY", "PRIVATE_KEY", "CONNECTION_STRING")
SECRETS, FINANCIAL, CONTACT = CATEGORY["secrets"], CATEGORY["financial"], CATEGORY["contact"]
GOVERNMENT = CATEGORY["government-identity"]
PROFILES = {
    "minimal": {t: 0.7 for t in [*SECRETS, *FINANCIAL]},
    "balanced": {t: 0.35 if t in EAGER else 0.5 for t in [*SECRETS, *FINANCIAL, *GOVERNMENT, *CONTACT, "PERSON"]},
    "strict": {t: 0.2 if t in EAGER else 0.25 for t in CATEGORY_OF},
}
