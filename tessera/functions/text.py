"""Text functions of a retrieval platform, as Column expressions: no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters beyond ASCII; the same class is understood by other engines.
LETTERS = r"[\p{L}\p{N}_]"
CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"

# Patterns of injected instructions, tried in this order, with the name of each.
INJECTIONS = (
    (r"忽略以上(所有)?指令", "忽略以上指令"),
    (r"忽略(以上|上面|上述)(的)?(所有)?(规则|提示|设定|约束)", "忽略以上规则"),
    (r"忽略所有指令", "忽略所有指令"),
    (r"你现在是\s*DAN", "DAN模式"),
    (r"(输出|泄露|告诉我|显示)\s*(你的)?\s*(system\s*prompt|系统提示词|提示词)", "泄露提示词"),
    (r"(改变|切换|替换)(你的)?角色", "改变角色"),
    (r"跳过引用", "跳过引用"),
    (r"调用未授权工具", "调用未授权工具"),
    (r"(无视|忽略|跳过)(以上|规则|约束)", "无视规则"),
    (r"(扮演|角色扮演模式|开发者模式|越狱|jailbreak)", "角色扮演越狱"),
    (r"(无视|忽略)(以上|上面)(所有)?(内容|指令|规则)", "无视以上内容"),
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|rules|prompts)", "ignore previous instructions"),
    (r"you\s+are\s+now\s+DAN", "DAN mode"),
    (r"(output|reveal|show|print|display)\s+(your\s+)?(system\s+)?prompt", "reveal system prompt"),
    (r"disregard\s+(all\s+)?(above|previous|prior)", "disregard above"),
    (r"forget\s+(all\s+)?(your\s+)?(rules|instructions|constraints)", "forget rules"),
    (r"(new|override|overwrite)\s+(system\s+)?(instructions|prompt|rules)", "override system"),
    (r"jailbreak", "jailbreak"),
)
# Comments and line beginnings that evidence is cleaned of.
COMMENT_INJECTION = r"(?is)<!--.*?(忽略|指令|ignore|instruction|输出|泄露|system\s*prompt|jailbreak).*?-->"
LINE_INJECTION = r"(?im)^\s*(忽略以上|忽略所有|ignore\s+(all\s+)?previous|你现在是\s*DAN|output\s+system\s+prompt|reveal\s+your\s+prompt|jailbreak|disregard\s+above|forget\s+your\s+rules|override\s+system)"
# Personal data.
ID_CARD = r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"
PHONE = r"1[3-9]\d{9}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# Beginnings of answers that decline to answer.
REFUSALS = (
    r"^(?:很抱歉[，,。 ]*)?(?:根据提供的参考资料[，, ]*)?(?:无法|不能|不可)(?:回答|确定|得知|读取|访问)",
    r"^(?:很抱歉[，,。 ]*)?(?:提供的|根据提供的)?(?:参考)?(?:资料|材料|信息|上下文|证据)(?:中)?(?:并)?(?:未|没有|不)(?:包含|提及|足以|支持)",
    r"^(?:很抱歉[，,。 ]*)?(?:提供的|根据提供的)?(?:参考)?(?:资料|材料|信息|上下文|证据)(?:不足|不充分)",
    r"^(?:您的提问|问题).*?(?:没有明确|不明确).*?请(?:补充|明确|说明)",
    r"^(?:sorry[,， ]*)?(?:i |we )?(?:cannot|can't|am unable to|are unable to)\s+(?:answer|determine|access|provide)\b",
    r"^(?:there is |the provided )?(?:insufficient|not enough)\s+(?:information|context|evidence)\b",
    r"^请(?:补充|明确|说明)",
    r"^please clarify\b",
)
# Where a compound question is split, and what is stripped from its parts.
COMPOUND = r"(?:[?？；;\n]+|另外|以及|并且|同时|然后|再问|还有)"
PART_MARKS = " ,，;；?？。"
UNRESOLVED = r"^(?:请问)?(?:它|这个|那个|该(?:项|值|参数|配置|功能|方案)|其)(?:的|是|为|有|怎么|如何)"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def estimate_tokens(text: Column) -> Column:
    """One for each CJK character, and for each other word or mark one per four characters begun; 0 for null."""
    t = text_or_empty(text)
    words = F.regexp_extract_all(F.regexp_replace(t, CJK, " "), F.lit(rf"{LETTERS}+|[^\p{{L}}\p{{N}}_\s]"), 0)
    return (F.regexp_count(t, F.lit(CJK)) + F.aggregate(words, F.lit(0), lambda a, w: a + F.greatest(F.lit(1), F.floor((F.char_length(w) + 3) / 4).cast("int")))).cast("long")


def split_compound(question: Column, most: int) -> Column:
    """The parts of a compound question, at most so many; a question of one part as it is; none of an empty one."""
    parts = F.filter(F.transform(F.split(text_or_empty(question), COMPOUND, -1), lambda p: F.btrim(p, F.lit(PART_MARKS))), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.slice(parts, 1, max(1, most))).when(text_or_empty(question) != "", F.array(question)).otherwise(F.array().cast("array<string>"))


def query_terms(query: Column, most: int = 12) -> Column:
    """Distinct Latin terms of two characters or more and CJK runs, lowered, in order."""
    found = F.regexp_extract_all(text_or_empty(query), F.lit(r"[A-Za-z][A-Za-z0-9_.:/-]{1,}|[\x{4e00}-\x{9fff}]{2,}"), 0)
    return F.slice(F.array_distinct(F.transform(found, lambda w: F.lower(w))), 1, most)


def injection(text: Column) -> Column:
    """The name of the first injection pattern that a text holds, or null."""
    return F.coalesce(*[F.when(F.rlike(text, F.lit(f"(?i){p}")), name) for p, name in INJECTIONS])


def sanitize_evidence(text: Column) -> Column:
    """Suspicious comments and line beginnings replaced by [filtered]."""
    return F.regexp_replace(F.regexp_replace(text, COMMENT_INJECTION, "[filtered]"), LINE_INJECTION, "[filtered]")


def mask_personal_data(text: Column) -> Column:
    """Id cards (18 characters: 6 + 8 + 4) keep 6 and 4 characters, phones 3 and 4, e-mail addresses 2 and the domain (none if there are two or fewer before it)."""
    card = F.regexp_replace(text, r"([1-9]\d{5})(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(\d{3}[\dXx])", "$1********$2")
    phone = F.regexp_replace(card, r"(1[3-9]\d)\d{4}(\d{4})", "$1****$2")
    return F.regexp_replace(F.regexp_replace(phone, r"([a-zA-Z0-9._%+-]{2})[a-zA-Z0-9._%+-]+(@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***$2"), r"(?<![a-zA-Z0-9._%+*-])[a-zA-Z0-9._%+-]{1,2}(@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "***$1")


def is_refusal(answer: Column) -> Column:
    """Whether an answer declines: it is empty, or begins with one of the fixed beginnings once white space is collapsed."""
    flat = F.btrim(F.regexp_replace(text_or_empty(answer), r"\s+", " "))
    return (flat == "") | reduce(lambda a, b: a | b, [F.rlike(flat, F.lit(f"(?i){p}")) for p in REFUSALS])


def needs_clarification(question: Column) -> Column:
    """Whether a question without history begins with a reference to nothing."""
    return F.rlike(F.regexp_replace(text_or_empty(question), r"\s+", ""), F.lit(UNRESOLVED))


def keywords(text: Column, most: int = 3) -> Column:
    """The first CJK runs or Latin words of two characters or more."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(r"[\x{4e00}-\x{9fff}]+|[A-Za-z][A-Za-z0-9_]*"), 0)
    return F.slice(F.filter(found, lambda w: F.char_length(w) >= 2), 1, most)


def answer_terms(text: Column) -> Column:
    """Distinct terms by which answers are compared: CJK characters and words of two ASCII characters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]{2,}"), 0), lambda w: F.lower(w)))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def redacted(text: Column) -> Column:
    """A digest and the length in place of a text; null stays null."""
    return F.concat(F.lit("[redacted sha256:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 12), F.lit(" chars:"), F.char_length(text).cast("string"), F.lit("]"))


def trigrams(text: Column) -> Column:
    """The set of lowered character 3-grams; empty below three characters."""
    low = F.lower(text)
    n = F.char_length(low)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


# How headings, back-ticked names and identifiers are written that count as names, what is stripped from them, and names that don't count.
HEADING_NAME, HEADING_NUMBER, TICKED_NAME = r"(?m)^#{1,6}\s+(.{2,80})$", r"^\d+(?:\.\d+)*[、.\s-]*", r"`([^`\n]{2,80})`"
IDENTIFIER = r"\b(?:[A-Z][A-Za-z0-9]+){1,}[A-Za-z0-9]*\b|\b[A-Za-z][A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+\b"
NAME_EDGES, NO_NAMES = " -:：，。", ("typescript", "javascript", "string", "true", "false")


def entities(content: Column, most: int = 12) -> Column:
    """Names that a chunk mentions, in this order: headings without their numbers, back-ticked names, capitalised identifiers and paths; distinct in lower case."""
    c = text_or_empty(content)
    heads = F.transform(F.regexp_extract_all(c, F.lit(HEADING_NAME), 1), lambda h: F.regexp_replace(h, HEADING_NUMBER, ""))
    ticked = F.regexp_extract_all(c, F.lit(TICKED_NAME), 1)
    capital = F.regexp_extract_all(c, F.lit(IDENTIFIER), 0)
    named = F.transform(F.concat(heads, ticked, capital), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(NAME_EDGES)))
    stop = F.array(*[F.lit(x) for x in NO_NAMES])
    good = F.filter(named, lambda x: F.char_length(x).between(2, 80) & ~F.array_contains(stop, F.lower(x)))
    return F.aggregate(
        good,
        F.array().cast("array<string>"),
        lambda a, x: F.when((F.size(a) >= most) | F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)),
    )


# Where an explicit compound question is split, and what is stripped from its parts.
EXPLICIT_COMPOUND = r"(?:以及|并且|同时|然后|；|;|\?{2,}|？{2,})"
EXPLICIT_MARKS = " ,，;；?？"


def decomposed(question: Column, most: int = 4) -> Column:
    """The parts of a question that is compound by its own marks, at most so many; else the question, white space collapsed; none of an empty one."""
    flat = F.btrim(F.regexp_replace(text_or_empty(question), r"\s+", " "))
    parts = F.filter(F.transform(F.split(flat, EXPLICIT_COMPOUND, -1), lambda p: F.btrim(p, F.lit(EXPLICIT_MARKS))), lambda p: p != "")
    return F.when(flat == "", F.array().cast("array<string>")).when(F.size(parts) > 1, F.slice(parts, 1, max(1, most))).otherwise(F.array(flat))


# Names too general to link two knowledge bases by.
GENERAL_NAMES = tuple(
    "and any api array block bool boolean class code create data delete description dict div else error false float for from get id if apikey authorization http https input int item json key list "
    "main map name node none not null object option output parse post put request response result return set span string system table tbody td text then password secret token true type update url "
    "user value void where with xml yaml".split()
)


def normalized_name(name: Column) -> Column:
    """A name in lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(text_or_empty(name)), r"[^\p{L}\p{N}]+", "")


def links_bases(name: Column) -> Column:
    """Whether a name may link knowledge bases: normalised, it has two characters with a CJK one or three without, isn't a number, and isn't one of the general names."""
    plain = normalized_name(name)
    least = F.when(F.rlike(plain, F.lit(r"[\x{4e00}-\x{9fff}]")), 2).otherwise(3)
    return (F.char_length(plain) >= least) & ~F.rlike(plain, F.lit(r"^\p{Nd}+$")) & ~plain.isin(*GENERAL_NAMES)


def markdown_table(headers: Column, rows: Column) -> Column:
    """A table as Markdown, short rows and headers filled up with empty cells; | is escaped and line ends become <br>. Empty if there are no columns."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    cell = lambda c: F.regexp_replace(F.replace(text_or_empty(c), F.lit("|"), F.lit("\\|")), "\n", "<br>")

    def line(w: Column, row: Column) -> Column:
        filled = F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), (w - F.size(row)).cast("int")))
        return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

    def whole(w: Column) -> Column:
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), w.cast("int")), " | "), F.lit(" |"))
        return F.when(w == 0, "").otherwise(F.array_join(F.concat(F.array(line(w, headers), rule), F.transform(rows, lambda r: line(w, r))), "\n"))

    return F.transform(F.array(width), whole)[0]


def iso_utc(at: Column) -> Column:
    """A timestamp without zone, taken as UTC, as ISO 8601 with Z; fractions of a second only where there are any."""
    micro = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro == "000000", "").otherwise(F.concat(F.lit("."), micro)), F.lit("Z"))


def fallback_terms(query: Column) -> Column:
    """Distinct terms by which chunks are compared without an index, in lower case: Latin ones of three characters or more, and CJK runs of two to six."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(query), F.lit(r"[A-Za-z][A-Za-z0-9_+.#/-]{2,}|[\x{4e00}-\x{9fff}]{2,6}"), 0), lambda w: F.lower(w)))
