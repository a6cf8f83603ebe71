"""Text functions as Columns: normalising, clipping, splitting, screening, signatures, scores.

Lengths are counted in code points unless ``utf16`` is said; they agree with UTF-16 units outside the astral planes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

CJK_WIDE = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
CLAUSE_TIERS = (("。", "！", "？", "!", "?"), ("；", ";", "，", "、"), (" ",))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used: keeps generated code small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def matches(text, pattern: str) -> Column:
    """Whether a neutral pattern occurs."""
    return _col(text).rlike(P.java(pattern))


def matches_any(text, patterns) -> Column:
    """Whether any of several neutral patterns occurs."""
    return _col(text).rlike(P.any_of(patterns))


def replace(text, pattern: str, by: str) -> Column:
    return F.regexp_replace(_col(text), F.lit(P.java(pattern)), F.lit(by.replace("$", r"\$") if "$1" not in by else by))


def trim(text) -> Column:
    """Without Unicode white space at both ends."""
    return replace(text, r"^\s+|\s+$", "")


def normalize(text) -> Column:
    """White space runs to one space, trimmed; null is empty."""
    return trim(replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))


def utf16_length(text) -> Column:
    """Length in UTF-16 code units."""
    return (F.length(F.encode(_col(text), "UTF-16BE")) / 2).cast("int")


def clip(text, most: int = 240) -> Column:
    """Normalised text cut hard at ``most`` with an ellipsis."""
    return _once(normalize(text), lambda v: F.when(F.length(v) <= most, v).otherwise(F.concat(replace(F.substring(v, 1, max(1, most - 1)), r"\s+$", ""), F.lit("…"))))


def clip_at_clause(text, most: int = 240) -> Column:
    """Normalised text cut after the last clause mark of the strongest tier that lies in its second half (T4)."""

    def cut_head(head: Column) -> Column:
        out = head
        for tier in reversed(CLAUSE_TIERS):
            # position from the left of each mark's last occurrence, counted from 1; 0 if it has none
            last = [F.length(head) - F.locate(mark, F.reverse(head)) + 1 for mark in tier]
            last = [F.when(F.contains(head, F.lit(mark)), at).otherwise(0) for mark, at in zip(tier, last)]
            cut = F.greatest(*last) if len(last) > 1 else last[0]
            out = F.when(cut - 1 >= most // 2, F.substring(head, F.lit(1), cut)).otherwise(out)
        return F.concat(replace(out, r"\s+$", ""), F.lit("…"))

    return _once(normalize(text), lambda v: F.when(F.length(v) <= most, v).otherwise(_once(F.substring(v, 1, max(1, most - 1)), cut_head)))


def excerpt(text, most: int = 160) -> Column:
    """The first ``most`` characters with an ellipsis if more follow (T5)."""
    return _once(normalize(text), lambda v: F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most), F.lit("…"))))


def hash_text(text) -> Column:
    """Identity of a text: 12 hex digits of the SHA-1 of its normalised lower case."""
    return F.substring(F.sha1(F.lower(normalize(text)).cast("binary")), 1, 12)


def split_sentences(text) -> Column:
    """Sentences, ends kept: after 。！？!?；; and line ends, and after a dot before white space and a word."""
    raw = replace(F.coalesce(_col(text), F.lit("")), r"\r\n?", "\n")
    cuts = F.split(raw, r"(?<=[。！？!?；;\n])|(?<=\.)(?=[" + P.SPACE + r"]+[\w\"'“(\x{4e00}-\x{9fff}])")
    return F.filter(F.transform(cuts, normalize), lambda s: s != "")


def estimate_tokens(text) -> Column:
    """Wide characters plus a quarter of the rest, rounded up."""
    value = F.coalesce(_col(text), F.lit(""))
    wide = F.regexp_count(value, F.lit(CJK_WIDE))
    return (wide + F.ceil((utf16_length(value) - wide) / 4)).cast("int")


def blocks_text(blocks, by: str = "\n") -> Column:
    """Texts of a message's text blocks, joined."""
    return F.array_join(F.transform(F.filter(_col(blocks), lambda b: b["type"] == "text"), lambda b: b["text"]), by)


def strip_pasted(text) -> Column:
    """Without what a paste leaves around a sentence: markup, scratch paths, a trailing list ordinal."""
    value = replace(F.coalesce(_col(text), F.lit("")), r"^\s*\\+(?:end|begin)\{[^}]*\}\s*", "")
    value = replace(value, r"^\s*\\+(?:item|hline)\b[\s\d.]*", "")
    value = replace(value, r"^\s*\\+(?:textbf|textit|emph|texttt)\{([^}]*)\}\s*", "$1")
    value = replace(value, P.SCRATCH_PATHS, "<path>")
    value = trim(replace(value, r"\s{2,}", " "))
    shorter = lambda v: trim(replace(v, r"\s*\d{1,2}[.、)）]\s*$", ""))
    return _once(value, lambda v: _once(shorter(v), lambda s: F.when(F.length(s) >= 12, s).otherwise(v)))


def folded(text) -> Column:
    """A text with its code, strings, paths, hashes and numbers folded, and white space runs as one space."""
    value = F.coalesce(_col(text), F.lit(""))
    for pattern, by in P.SIGNATURE_FOLDS:
        value = replace(value, pattern, by)
    return replace(value, r"\s+", " ")


def signature(text) -> Column:
    """What remains of a text when code, strings, paths, hashes and numbers are folded."""
    return F.lower(trim(folded(text)))


def echo_form(text) -> Column:
    """Lower case without white space and punctuation."""
    return F.translate(replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"\s+", ""), P.ECHO_IGNORED, "")


def type_signal(text) -> Column:
    """The first family with a hit as struct(type, weight, hits); hits are positions in the family."""
    out = F.struct(F.lit(None).cast("string").alias("type"), F.lit(0.0).alias("weight"), F.array().cast("array<int>").alias("hits"))
    for name, weight, family in reversed(P.TYPE_SIGNALS):
        hits = F.array_compact(F.array(*[F.when(matches(text, p), F.lit(k)) for k, p in enumerate(family)]))
        out = F.when(matches_any(text, family), F.struct(F.lit(name).alias("type"), F.lit(weight).alias("weight"), hits.alias("hits"))).otherwise(out)
    return out


def signal_type(text) -> Column:
    """Name of the first family with a hit, or null."""
    out = F.lit(None).cast("string")
    for name, _, family in reversed(P.TYPE_SIGNALS):
        out = F.when(matches_any(text, family), F.lit(name)).otherwise(out)
    return out


def signal_weight(text) -> Column:
    """Weight of the first family with a hit, or 0."""
    out = F.lit(0.0)
    for _, weight, family in reversed(P.TYPE_SIGNALS):
        out = F.when(matches_any(text, family), F.lit(weight)).otherwise(out)
    return out


def emphasis_weight(text) -> Column:
    """Sum of the emphasis groups that hit."""
    total = F.lit(0.0)
    for weight, group in P.EMPHASIS:
        total = total + F.when(matches_any(text, group), F.lit(weight)).otherwise(F.lit(0.0))
    return total


def candidate_score(text) -> Column:
    """Interest of a sentence before any judgement (M1)."""
    return F.least(F.lit(1.0), F.lit(0.35) + signal_weight(text) * 0.35 + emphasis_weight(text) + F.least(F.lit(0.15), F.length(_col(text)) / 800))


def names_in(text) -> Column:
    """Distinct name-like words, in order."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(P.java(P.NAME_LIKE)), F.lit(0)))


def name_bonus(names, text, bonus: float = 16.0) -> Column:
    """The bonus for each name that a text holds verbatim."""
    return F.size(F.filter(_col(names), lambda n: F.contains(_col(text), n))) * F.lit(float(bonus))


def is_noise(text) -> Column:
    """Nothing but an acknowledgement."""
    return matches_any(text, P.NOISE)


def looks_interrogative(text) -> Column:
    """Six anchored question tests."""
    return _once(normalize(text), lambda v: (v != "") & matches_any(v, P.INTERROGATIVES))


def asserts_decision(text) -> Column:
    """A decision stated, even in a question."""
    stated, particle = P.DECISION_STATED
    return matches_any(text, P.DECISION_ASSERTIONS) | matches(text, f"{stated}(?!{particle.removeprefix('^')})")


def screen(text) -> Column:
    """Why a sentence may not become a memory, or null; the first rule that fits decides (F1)."""
    question = looks_interrogative(text) | (matches(text, P.QUESTION_MARKERS) & ~matches(text, P.INSTRUCTION_MARKERS))
    return (
        F.when(matches_any(text, P.TRANSCRIPTS), "transcript")
        .when(matches_any(text, P.SECRETS), "secret")
        .when(~matches_any(text, P.REMEMBER_REQUESTS) & matches_any(text, P.TASK_INSTRUCTIONS), "task-instruction")
        .when(matches_any(text, P.PAYLOADS), "payload")
        .when(matches_any(text, P.FRAGMENTS), "fragment")
        .when(is_noise(text), "noise")
        .when(asserts_decision(text), F.lit(None))
        .when(question, "question")
    )


def is_noteworthy(reason) -> Column:
    """Whether a veto deserves a ledger line."""
    return F.coalesce(_col(reason).isin(*P.NOTEWORTHY_VETOES), F.lit(False))


def has_diagnostic(detail) -> Column:
    """Whether a failure says more than a bare code."""
    return _once(trim(detail), lambda v: (v != "") & ~matches(v, P.BARE_ERRORS) & ~matches(v, P.BARE_CODE))


def failure_kept(text) -> Column:
    """The same, for a rendered failure: what follows its first colon counts."""
    return has_diagnostic(replace(text, r"^[^:：]*[:：]\s*", ""))


def summary_drift(summary, source) -> Column:
    """The first name of a summary that its source lacks, or null."""
    all_names = F.regexp_extract_all(_col(summary), F.lit(P.java(P.NAME_LIKE)), F.lit(0))
    return F.get(F.filter(all_names, lambda n: ~F.contains(F.lower(_col(source)), F.lower(n))), 0)


def project_root(path) -> Column:
    """The first four segments of an absolute path."""
    return F.array_join(F.slice(F.split(_col(path), "/"), 1, 5), "/")


def archive_id(session, seq) -> Column:
    """Address of an archived message."""
    return F.concat(F.lit("l0:"), F.coalesce(_col(session), F.lit("")), F.lit(":"), _col(seq).cast("string"))


def iso_date(millis) -> Column:
    """UTC date of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(_col(millis)), "yyyy-MM-dd")


def decode_workspace(name) -> Column:
    """A directory name with its ~hex~ escapes decoded (T21); the check that the folder exists is left to the caller."""
    parts = F.split(_col(name), "~")
    # odd pieces stand between two tildes and are hex code points
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.decode(F.unhex(F.lpad(p, 4, "0")), "UTF-16BE")).otherwise(p)), "")
