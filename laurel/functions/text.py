"""Column expressions over text: tokens, token containment, skills, hashes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from laurel import vocab

TOKEN_PATTERN = "[a-z0-9+#./-]+"
RERANK_TOKEN_PATTERN = "[a-z0-9+#.]+"
_META = set(r".+*?^$()[]{}|\\")


def quote(literal: str) -> str:
    """Regex-quote a literal in a form both Java and RE2 accept."""
    return "".join("\\" + ch if ch in _META else ch for ch in literal)


def alternation(literals: Iterable[str]) -> str:
    return "|".join(quote(x) for x in literals)


def contains_any(text: Column, tokens: Iterable[str]) -> Column:
    """True when any token is a substring; one regex scan, best for short strings and
    inside array lambdas. A place is left at its first letter unless a token begins so."""
    tokens = sorted(set(tokens))
    if not all(tokens):
        return text.rlike("")
    first = "".join(ch if ch.isalnum() else "\\" + ch for ch in sorted({t[0] for t in tokens}))
    return text.rlike(f"(?=[{first}]){longest_of(tokens)}" if first else "")


def text_contains_any(text: Column, tokens: Iterable[str]) -> Column:
    """The same for long texts: compiled byte searches that stop at the first hit."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens])


def count_contained(text: Column, tokens: Iterable[str]) -> Column:
    """How many different tokens occur as substrings."""
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in tokens])


def first_rule(text: Column, rules, default, contains=contains_any) -> Column:
    """Value of the first (value, tokens) rule that matches, else the default."""
    out = None
    for value, tokens in rules:
        hit = contains(text, tokens)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def rerank_tokens(text: Column) -> Column:
    """Coarser tokens without stop words and one-letter tokens."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(RERANK_TOKEN_PATTERN), F.lit(0))
    return F.filter(
        raw, lambda t: (F.length(t) > 1) & ~t.isin(list(vocab.RERANK_STOP_WORDS))
    )


def join_nonempty(parts: list[Column], arrays: list[Column] | None = None) -> Column:
    """Space-join of the non-empty strings of ``parts`` and then of the arrays, trimmed."""
    pieces = [F.array(*[F.coalesce(p, F.lit("")) for p in parts])]
    pieces += [F.transform(a, lambda x: F.coalesce(x, F.lit(""))) for a in arrays or []]
    flat = pieces[0] if len(pieces) == 1 else F.concat(*pieces)
    return F.trim(F.array_join(F.filter(flat, lambda x: x != ""), " "))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# --- skills ---------------------------------------------------------------------------


def longest_of(words: Iterable[str]) -> str:
    """A pattern of the longest of these words at a place: a trie, so that a text is walked once
    whatever their number."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def write(node: dict) -> str:
        parts = [quote(letter) + write(child) for letter, child in sorted(node.items()) if letter]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")

    return write(root)


def extract_skills(text: Column, word_boundary: bool = False) -> Column:
    """Sorted canonical skills named in a text, found in one pass.

    A spelling counts when no letter or digit stands before it; what follows is not
    looked at, so ``es`` also matches "essential". ``word_boundary`` asks for an end too.
    """
    low = F.lower(text)
    aliases = vocab.skill_aliases()
    if word_boundary:
        hits = [
            F.when(
                text_contains_any(low, spellings)
                & low.rlike(f"(?<![a-z0-9])(?:{alternation(spellings)})(?![a-z0-9])"), F.lit(skill),
            )
            for skill, spellings in sorted(aliases.items())
        ]
        return F.array_compact(F.array(*hits))
    owners: dict[str, set[str]] = {}
    for skill, spellings in aliases.items():
        for spelling in spellings:
            owners.setdefault(spelling, set()).add(skill)
    # where the longest spelling stands, so do all that it begins with
    named = {
        longest: sorted({s for other in owners if longest.startswith(other) for s in owners[other]})
        for longest in owners
    }
    skills = F.create_map(*[
        x for spelling, found in named.items()
        for x in (F.lit(spelling), F.array(*map(F.lit, found)))
    ])
    # a place that is only looked at, so that spellings may overlap
    pattern = f"(?<![a-z0-9])(?=({longest_of(owners)}))"
    hits = F.array_distinct(F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(pattern), F.lit(1)))
    return F.array_sort(F.array_distinct(F.flatten(
        F.transform(hits, lambda h: F.element_at(skills, h))
    )))


def canonical_skill(name: Column) -> Column:
    """Canonical form of one skill string: itself when canonical, else the first entry
    with a spelling inside it, else null."""
    table = vocab.skill_aliases()
    n = F.lower(F.trim(name))
    out = F.when(n.isin(list(table)), n)
    for skill, spellings in table.items():
        out = out.when(contains_any(n, spellings), F.lit(skill))
    return out


def canonical_skills(names: Column) -> Column:
    """Distinct sorted canonical skills of a list of strings."""
    return F.array_sort(
        F.array_distinct(F.array_compact(F.transform(names, canonical_skill)))
    )


def skill_category(skill: Column) -> Column:
    low = F.lower(skill)
    return (
        F.when(low.isin(list(vocab.CORE_ML_SKILLS)), "ml")
        .when(low.isin(list(vocab.LLM_SKILLS)), "llm")
        .when(low.isin(list(vocab.RETRIEVAL_SKILLS)), "retrieval")
        .otherwise("general")
    )


# --- hashes ---------------------------------------------------------------------------


def content_hash(*parts: Column) -> Column:
    joined = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return F.sha2(joined, 256)


def crc32_code(token: Column) -> Column:
    return F.crc32(F.encode(token, "UTF-8"))


def md5_code(token: Column) -> Column:
    """First 32 bits of the MD5 digest, for engines that have no crc32."""
    return F.conv(F.substring(F.md5(F.encode(token, "UTF-8")), 1, 8), 16, 10).cast("bigint")


TOKEN_CODES = {"crc32": crc32_code, "md5": md5_code}


def id_seed(value: Column) -> Column:
    """Sum of the character codes of an id."""
    return F.aggregate(
        F.split(value, ""), F.lit(0), lambda acc, ch: acc + F.coalesce(F.ascii(ch), F.lit(0))
    )


# --- JSON -----------------------------------------------------------------------------


def json_object(raw: Column) -> Column:
    """The JSON object in a noisy reply: fences removed, else the outermost braces; null
    when neither parses. The result is JSON text."""
    body = F.trim(raw)
    unfenced = F.when(
        body.startswith("```"),
        F.trim(F.regexp_replace(body, r"(?s)^`+(?:[ \t]*(?i:json)?[ \t]*\r?\n)?|`+$", "")),
    ).otherwise(body)
    braces = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    whole = F.when(_is_json_object(unfenced), unfenced)
    inner = F.when(_is_json_object(braces), braces)
    return F.coalesce(whole, inner)


def _is_json_object(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull()
