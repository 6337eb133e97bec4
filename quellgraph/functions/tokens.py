"""Delegation tokens, guard decisions and the sensor's score, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TTL_SECONDS, YOUNG_SECONDS = 300.0, 60.0


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, by the definition: two nested hashes over the padded key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def token_message(token_id: Column, origin: Column, target: Column, nonce: Column, timestamp: Column) -> Column:
    return F.concat(token_id, origin, target, nonce, timestamp.cast("string"))


def token_verdict(signed: Column, age: Column, depth: Column, max_depth: Column, seen: Column, ttl: Column | float = TTL_SECONDS) -> Column:
    """The first check that fails: signature, age, depth, nonce; ``valid`` if none."""
    ttl = ttl if isinstance(ttl, Column) else F.lit(ttl)
    return F.when(~signed, "invalid_signature").when(age > ttl, "token_expired").when(depth > max_depth, "depth_exceeded").when(seen, "nonce_replayed").otherwise("valid")


def guard_decision(base: Column, strictness: Column, depth: Column, max_depth: Column, age: Column, approved: Column) -> Column:
    """``struct(decision, reason)`` of one guard. ``base`` is the token's verdict, ``approved`` whether its origin is on the list."""
    strict = strictness.isin("ELEVATED", "LOCKDOWN")
    of = lambda d, r: F.struct(F.lit(d).alias("decision"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(base != "valid", of("BLOCKED", F.concat(F.lit("base_check:"), base)))
        .when(strict & (depth > max_depth - 1), of("BLOCKED", "elevated:depth_exceeds_strict_limit"))
        .when(strict & (age > YOUNG_SECONDS), of("BLOCKED", "elevated:token_age_exceeds_60s"))
        .when((strictness == "LOCKDOWN") & ~approved, of("BLOCKED", "lockdown:origin_not_in_whitelist"))
        .when(strictness == "LOCKDOWN", of("FLAGGED", "lockdown:flagged_for_review"))
        .otherwise(of("ALLOWED", "all_checks_passed"))
    )


def consensus(n_guards: Column, n_allowed: Column, required: int = 2) -> Column:
    """ALLOWED if no guard stands on the edge or enough allow; a flag counts as a block."""
    return F.when((n_guards == 0) | (n_allowed >= required), "ALLOWED").otherwise("BLOCKED")


def strictness_of(risk: Column) -> Column:
    return F.when(risk >= 0.75, "LOCKDOWN").when(risk >= 0.4, "ELEVATED").otherwise("NOMINAL")


def anomaly_score(frequency: Column, success_rate: Column, escalations: Column, jumps: Column) -> Column:
    share = lambda x, most: F.least(F.lit(1.0), x / most)
    return 0.3 * share(frequency, 5.0) + 0.2 * F.greatest(F.lit(0.0), (0.8 - success_rate) / 0.8) + 0.3 * share(escalations, 5.0) + 0.2 * share(jumps, 3.0)


def short_hash(value: Column, length: int) -> Column:
    """The first ``length`` bytes of the SHA-256 of a text."""
    return F.substring(F.unhex(F.sha2(F.encode(value, "UTF-8"), 256)), 1, length)


def little_endian(value: Column, width: int) -> Column:
    """An unsigned integer as ``width`` bytes, lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.substring(digits, F.lit(15) - 2 * i, F.lit(2)))
    return F.unhex(F.concat_ws("", pairs))


# Words in a device's answer, from failures to successes: any of the first set, with any of the second if there is one.
DEVICE_FAILURES = (
    (("HMAC", "SIGNATURE"), ("FAIL", "ERR", "INVALID", "MISMATCH", "DIFF"), "hw:invalid_signature"),
    (("EXPIRE", "TTL"), (), "hw:token_expired"),
    (("DEPTH",), ("EXCEED", "FAIL", "ERR", "VIOLATION"), "hw:depth_exceeded"),
    (("REPLAY",), (), "hw:nonce_replayed"),
    (("NONCE",), ("FAIL", "DUP", "REJECT"), "hw:nonce_replayed"),
)
DEVICE_SUCCESSES = ("ACCESS OK", "VALID", "PASS", "ALLOWED")
DEVICE_REJECTIONS = ("FAIL", "ERR", "REJECT", "DENIED")


def device_decision(response: Column) -> Column:
    """``struct(decision, reason)`` of a device's text answer; failures are looked for before successes."""
    up, head = F.upper(response), F.substring(F.trim(response), 1, 50)
    found = lambda ws: reduce(lambda a, b: a | b, [up.contains(w) for w in ws])
    of = lambda d, r: F.struct(F.lit(d).alias("decision"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    out = None
    for first, second, reason in DEVICE_FAILURES:
        test = found(first) & found(second) if second else found(first)
        out = F.when(test, of("BLOCKED", reason)) if out is None else out.when(test, of("BLOCKED", reason))
    out = out.when(found(DEVICE_SUCCESSES), of("ALLOWED", "hw:all_checks_passed"))
    return out.when(found(DEVICE_REJECTIONS), of("BLOCKED", F.concat(F.lit("hw:rejected:"), head))).otherwise(of("BLOCKED", F.concat(F.lit("hw:unrecognized:"), head)))


# Numbers of the device's frame.
EDGE_NUMBERS = {"ASSUME_ROLE": 1, "TOKEN_MINT": 2, "SECRET_READ": 3, "DEPLOY_TO": 4, "AUTHENTICATE_AS": 5}
STRICTNESS_NUMBERS = {"NOMINAL": 1, "ELEVATED": 2, "LOCKDOWN": 3}


def device_frame(token: Column, strictness: Column, key: bytes) -> Column:
    """The 82 bytes for a device: a 50-byte little-endian message and its 32-byte HMAC.

    ``token`` is a struct of token_id, origin_node, target_node, delegation_depth, max_depth, timestamp, ttl_seconds, nonce
    (hex) and edge_type. Numbers too large for their place are clamped, a short nonce is filled with zeros.
    """
    number = lambda c, names, default: F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], F.lit(default))
    message = F.concat(
        short_hash(token["token_id"], 16), short_hash(token["origin_node"], 8), short_hash(token["target_node"], 8),
        little_endian(F.least(token["delegation_depth"], F.lit(255)), 1), little_endian(F.least(token["max_depth"], F.lit(255)), 1),
        little_endian(F.pmod(F.floor(token["timestamp"]).cast("bigint"), F.lit(1 << 32)), 4), little_endian(F.least(F.floor(token["ttl_seconds"]).cast("bigint"), F.lit(65535)), 2),
        F.unhex(F.rpad(F.substring(token["nonce"], 1, 16), 16, "0")),
        little_endian(number(token["edge_type"], EDGE_NUMBERS, 0), 1), little_endian(number(strictness, STRICTNESS_NUMBERS, 1), 1),
    )
    return F.concat(message, F.unhex(hmac_sha256(key, message)))
