"""Removal of prompt injections and active markup from texts of others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "[SANITIZED]"
#: Threat classes and patterns, applied in this order, each to what the one before has left.
PATTERNS = [
    ("instruction_hijack", r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+instructions?"),
    ("instruction_hijack", r"(?i)disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|context|rules?)"),
    ("instruction_hijack", r"(?i)(you\s+are\s+now|act\s+as|pretend\s+(to\s+be|you\s+are)|roleplay\s+as)\s+\w"),
    ("instruction_hijack", r"(?i)(as\s+a\s+DAN|do\s+anything\s+now|jailbreak\s+mode)"),
    ("instruction_hijack", r"(?i)(new\s+system\s+prompt|override\s+(the\s+)?(system|assistant)\s+prompt)"),
    ("instruction_hijack", r"(?i)forget\s+(everything|all|your\s+(previous|prior))\s+(you\s+)?know"),
    ("structural_injection", r"(?i)<\|?(system|user|assistant|im_start|im_end)\|?>"),
    ("structural_injection", r"(?i)\[/?INST\]|\[/?SYS\]"),
    ("structural_injection", r"(?im)(^|\n)(Human|Assistant|User|Bot|System)\s*:\s"),
    ("structural_injection", r"(?i)</?(s|eos|pad|unk|bos)>"),
    ("structural_injection", r"(?is)```[a-z]*\s*(ignore|override|system|instruction)"),
    ("script_injection", r"(?is)<script[^>]*>.*?</script>"),
    ("script_injection", r"(?i)javascript\s*:"),
    ("script_injection", r"(?i)on(load|click|error|mouseover|focus|blur|input|submit)\s*="),
    ("script_injection", r"(?i)data\s*:\s*text/html"),
    ("script_injection", r"(?i)\[([^\]]*)\]\(javascript:[^\)]*\)"),
]


def sanitized(text: Column, most: int | None = 50_000) -> Column:
    """Struct of text, modified and hits (matches of each threat class). Texts are read up to ``most`` characters, as the contract has it; None reads them whole."""
    original = F.substring(text, 1, most) if most else text
    zero = F.struct(original.alias("text"), *(F.lit(0).alias(c) for c in classes()))
    steps = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(p).alias("p")) for c, p in PATTERNS))
    step = lambda acc, x: F.struct(F.regexp_replace(acc["text"], x["p"], F.lit(PLACEHOLDER)).alias("text"), *((acc[c] + F.when(x["c"] == c, F.regexp_count(acc["text"], x["p"])).otherwise(0)).alias(c) for c in classes()))
    return F.aggregate(steps, zero, step, lambda acc: F.struct(acc["text"].alias("text"), (acc["text"] != original).alias("modified"), *(acc[c].alias(c) for c in classes())))


def classes() -> list[str]:
    return list(dict.fromkeys(c for c, _ in PATTERNS))


def oracle_sql(table: str, key: str, text: str, most: int = 50_000) -> str:
    """DuckDB SQL of key, body (MD5 of the text), modified and the number of hits of each class."""
    quoted = [(c, p.replace("'", "''")) for c, p in PATTERNS]
    parts = [f"s0 AS (SELECT {key}, substr({text}, 1, {most}) AS original, substr({text}, 1, {most}) AS t, {', '.join(f'0 AS {c}' for c in classes())} FROM {table})"]
    for i, (c, p) in enumerate(quoted, 1):
        kept = ", ".join(f"{x} + len(regexp_extract_all(t, '{p}')) AS {x}" if x == c else x for x in classes())
        parts.append(f"s{i} AS (SELECT {key}, original, regexp_replace(t, '{p}', '{PLACEHOLDER}', 'g') AS t, {kept} FROM s{i - 1})")
    return f"WITH {', '.join(parts)} SELECT {key}, md5(t) AS body, t <> original AS modified, {', '.join(f'CAST({c} AS INT) AS {c}' for c in classes())} FROM s{len(quoted)}"
