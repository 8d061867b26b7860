"""Character names: normal form, titles, and the parsed form that matching and scoring use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import SPACE, let

# Title synonyms, generic words and the roles that go with a title.
TITLES = {
    "dr": "doctor", "dr.": "doctor", "doctor": "doctor", "mr": "mr", "mr.": "mr", "mister": "mr", "mrs": "mrs", "mrs.": "mrs", "missus": "mrs",
    "miss": "miss", "ms": "ms", "ms.": "ms", "capt": "captain", "capt.": "captain", "capn": "captain", "captain": "captain", "sir": "sir",
    "lady": "lady", "lord": "lord", "prof": "professor", "prof.": "professor", "professor": "professor", "rev": "reverend", "rev.": "reverend",
    "reverend": "reverend",
}
GENERIC = (
    "doctor", "captain", "mr", "mrs", "miss", "ms", "professor", "reverend", "sir", "lady", "lord", "narrator", "mother", "father", "boy", "girl",
    "man", "woman", "stranger", "innkeeper",
)
ROLE_HINTS = {
    "doctor": ("doctor", "physician", "surgeon", "magistrate"),
    "captain": ("captain", "sailor", "seaman", "pirate", "buccaneer"),
    "professor": ("professor", "teacher"),
    "reverend": ("priest", "clergyman", "reverend"),
}
#: The resolver knows one more title and generic word than the merger.
RESOLVER_TITLES = TITLES | {"squire": "squire"}
RESOLVER_GENERIC = (*GENERIC, "squire")


def norm(c: Column) -> Column:
    """Lower case; quotes go, only a-z, digits, white space, dot, hyphen and underscore stay; separators become one space."""
    s = F.regexp_replace(F.lower(c), rf"[^a-z0-9{SPACE}_.-]", "")
    return F.trim(F.regexp_replace(s, rf"[{SPACE}_-]+", " "))


def folded(c: Column) -> Column:
    """norm() that keeps the letters of every script: lower case, quotes and other signs gone, separators one space. Case and accents are left to a collation."""
    s = F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{M}}\p{{N}}{SPACE}_.-]", "")
    return F.trim(F.regexp_replace(s, rf"[{SPACE}_-]+", " "))


def key_of(c: Column, collation: str | None = None) -> Column:
    """What names are grouped by: norm(), or folded() under a collation such as UNICODE_CI_AI, which takes Élodie and elodie for one."""
    return norm(c) if collation is None else F.collate(folded(c), collation)


def form(c: Column, titles: dict = TITLES, generic: tuple = GENERIC) -> Column:
    """struct(normalized, title, base, surname, given, is_generic) of a name.

    normalized is the tokens with titles in their one form and leading articles gone, base what follows the title.
    """
    table = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv])
    known = F.array(*[F.lit(t) for t in sorted(set(titles.values()))])

    def parts(tokens):
        first = F.try_element_at(tokens, F.lit(1))
        title = F.when(F.array_contains(known, first), first)
        return let(F.struct(tokens.alias("all"), title.alias("title"), F.when(title.isNotNull(), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens).alias("base")), parsed)

    def parsed(p):
        plain = F.array_join(p["all"], " ")
        return F.struct(
            plain.alias("normalized"),
            p["title"].alias("title"),
            F.array_join(p["base"], " ").alias("base"),
            F.try_element_at(p["base"], F.lit(-1)).alias("surname"),
            F.when(F.size(p["base"]) > 1, F.get(p["base"], F.lit(0))).alias("given"),
            (((F.size(p["base"]) == 0) & p["title"].isNotNull()) | plain.isin(*generic)).alias("is_generic"),
        )

    bare = F.regexp_replace(norm(c), "^(?:the(?: |$))+", "")
    return let(F.transform(F.filter(F.split(bare, " "), lambda t: t != ""), lambda t: F.coalesce(F.element_at(table, t), t)), parts)


def role_state(title: Column, roles: Column) -> Column:
    """What the roles say about a title: free (a title without hints), hit (one of the roles holds a hint), none (no roles) or miss."""
    joined = F.lower(F.array_join(roles, " "))
    hits = F.lit("free")
    for t, hints in ROLE_HINTS.items():
        hit = F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(joined, h))
        hits = F.when(title == t, F.when(hit, "hit").when(F.size(roles) == 0, "none").otherwise("miss")).otherwise(hits)
    return hits


def match_rule(a: Column, b: Column, a_roles: Column, b_roles: Column) -> Column:
    """struct(confidence, reason, score) of the first rule that two name forms meet; the roles are arrays."""

    def rule(confidence, reason, score):
        return F.struct(F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), F.lit(score).alias("score"))

    same_surname = a["surname"].isNotNull() & (a["surname"] == b["surname"])
    one_untitled = (a["title"].isNull() != b["title"].isNull()) & (a["base"] == b["base"])
    x, y = role_state(a["title"], a_roles), role_state(a["title"], b_roles)
    fit = (x == "free") | (x == "hit") | (y == "hit") | ((x == "none") & (y == "none"))
    generic = lambda p, q: p["is_generic"] & (p["title"] == q["title"]) & q["surname"].isNotNull() & fit
    return (
        F.when(a["normalized"] == b["normalized"], rule("safe", "exact_normalized_match", 100))
        .when(same_surname & (a["title"] == b["title"]), rule("safe", "same_title_same_surname", 96))
        .when(same_surname & one_untitled, rule("probable", "bare_name_matches_titled_full_name", 88))
        .when(generic(a, b) | generic(b, a), rule("probable", "generic_title_to_single_titled_name_candidate", 78))
        .otherwise(rule("review", "no_safe_merge_rule", 0))
    )
