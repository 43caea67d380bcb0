"""Risk tiers of scan units: words of paths, names and signatures, then overrides and a floor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.text import fragments, glob_regex

# Tiers from the gravest on, and the words that put a unit in one.
TIERS = ("critical", "high", "medium", "low")
CRITICAL_PATH = (
    "bootloader", "boot", "crypto", "secure", "security", "ipc", "attest", "tls", "ssl", "keystore", "keys", "cert",
    "signature", "verify", "mpu", "trustzone", "psa",
)
CRITICAL_SYMBOL = ("isr", "irq", "interrupt", "handler", "vector", "fault", "exception")
HIGH_PATH = (
    "parse", "parser", "decode", "decoder", "codec", "proto", "protocol", "net", "network", "http", "tcp", "udp", "ip",
    "usb", "uart", "serial", "spi", "i2c", "can", "modbus", "packet", "frame", "message", "json", "xml", "asn1", "tlv",
    "dfu", "ota", "update", "firmware", "flash", "input", "command", "shell", "cli",
)
HIGH_SYMBOL = (
    "parse", "parser", "decode", "decoder", "unpack", "deserialize", "recv", "receive", "read", "scan", "handle",
    "process", "validate", "check", "verify", "load", "import", "extract", "convert", "input", "packet", "frame",
    "message", "cmd", "command",
)
LOW_PATH = ("led", "gpio", "config", "conf", "settings", "example", "demo", "test", "mock", "stub")
LOW_SYMBOL = ("led", "gpio", "get", "is", "getter", "dump", "print", "log", "trace", "delay", "sleep")
LENGTH_PARAMETER = r"(?i)\b(?:len|length|size|count|n|nbytes|num|sz|cb)\w*\b"
OPAQUE_BUFFER = r"\bvoid\s*\*|\b(?:unsigned\s+)?char\s*\*|\buint8_t\s*\*|\bu8\s*\*"


def opaque_with_length(signature: Column) -> Column:
    """An untyped buffer together with a length among the parameters."""
    at = F.instr(signature, F.lit("("))
    parameters = F.when(at > 0, F.substring(signature, at, F.length(signature))).otherwise("")
    return signature.rlike(OPAQUE_BUFFER) & parameters.rlike(LENGTH_PARAMETER)


def automatic_tier(path: Column, name: Column, kind: Column, signature: Column, header: Column, dead: Column) -> Column:
    """Struct of tier and reason; the first rule that fits decides."""
    hits = lambda text, words: F.array_sort(F.array_intersect(fragments(text), F.array(*map(F.lit, words))))
    result = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), reason.alias("reason"))
    function = kind == "function"
    rules = []
    for tier, word_kind, source, words, cond in (
        ("critical", "path:", path, CRITICAL_PATH, F.lit(True)),
        ("critical", "symbol:", name, CRITICAL_SYMBOL, function),
        ("critical", "signature:opaque-buffer-with-length", None, None, function & opaque_with_length(signature)),
        ("high", "path:", path, HIGH_PATH, F.lit(True)),
        ("high", "symbol:", name, HIGH_SYMBOL, function),
        ("low", "kind:", None, None, ~function),
        ("low", "header", None, None, header),
        ("low", "inactive-preprocessor-branch", None, None, dead),
        ("low", "path:", path, LOW_PATH, F.lit(True)),
        ("low", "symbol:", name, LOW_SYMBOL, F.lit(True)),
    ):
        if words is None:
            reason = F.concat(F.lit(word_kind), kind) if word_kind == "kind:" else F.lit(word_kind)
            rules.append(F.when(F.coalesce(cond, F.lit(False)), result(tier, reason)))
        else:
            found = hits(source, words)
            reason = F.concat(F.lit(word_kind), F.array_join(found, ","))
            rules.append(F.when(cond & (F.size(found) > 0), result(tier, reason)))
    return F.coalesce(*rules, result("medium", F.lit("default")))


def tier_rank(tier: Column) -> Column:
    """0 for the gravest; unknown tiers come last."""
    at = F.array_position(F.array(*map(F.lit, TIERS)), F.lower(F.trim(tier)))
    return F.when(at > 0, at - 1).otherwise(len(TIERS))


def overridden(path: Column, tier: Column, overrides: list[tuple[str, str]]) -> Column:
    """C17: the last override whose glob fits the path, its name or a directory above it."""
    for pattern, wanted in overrides:
        plain = pattern.rstrip("/")
        hit = path.rlike(f"^{glob_regex(pattern).replace('[^/]', '.')}$") | path.rlike(f"(?:^|/){glob_regex(pattern)}$")
        hit = hit | (path == plain) | F.startswith(path, F.lit(plain + "/"))
        tier = F.when(hit, wanted).otherwise(tier)
    return tier


def at_least(tier: Column, floor: str) -> Column:
    """No tier below the floor."""
    return F.when(tier_rank(tier) > TIERS.index(floor), floor).otherwise(tier)
