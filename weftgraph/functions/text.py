"""Text and name expressions; all of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.schema import BOOK_ERA, ERA_KEYWORDS, NOISE_NAMES

# Title suffixes in the order they are tried, surname spellings.
TITLE_SUFFIXES = (
    "道长", "真人", "大师", "禅师", "师太", "国师", "大侠", "侠客", "女侠", "侠侣", "前辈", "老前辈", "老人家",
    "师父", "师傅", "恩师", "师尊", "兄台", "阁下", "足下",
)
SURNAME_SPELLINGS = {"诸葛氏": "诸葛", "欧阳氏": "欧阳", "上官氏": "上官", "令狐氏": "令狐", "司马氏": "司马", "南宫氏": "南宫", "慕容氏": "慕容"}

# Kinship terms, hints of the other relations, negations, punctuation of answers.
KINSHIP = "父亲|母亲|爸爸|妈妈|爹|娘|父母|儿子|女儿|子女|孩子|之子|之女|之孙|所生|生下|亲生|骨肉|后母|继母|养父|养母|诞下|生有|独子|独女|长子|次子|长女|次女"
HINTS = {
    "MASTER_OF": "师|徒弟|弟子|传授|学艺|拜|教|授", "SPOUSE_OF": "夫妻|妻|夫|婚|嫁|娶|配偶|夫人", "SWORN_BROTHER_OF": "结拜|义兄|义弟|金兰|兄弟",
    "ENEMY_OF": "仇|敌|对头|恨", "BELONGS_TO": "门|帮|派|教|会|属|弟", "MASTERS": "掌|法|剑|刀|拳|功|招|武|棍|棒|指", "FOUNDER_OF": "创|立|开派|祖师",
    "LOCATED_IN": "在|于|位于|处|山|岛|城", "BRANCHED_FROM": "演化|源自|演变|由.{0,6}而来", "DESCENDANT_OF": "之后|后人|之女|之子|血脉|后裔",
}
NEGATIONS = ("不是", "并非", "没有", "不属于", "非是", "而不是", "不认识", "未")
PUNCTUATION = "`*_#~。，、；：！？（）()【】[]{}“”‘’\"'：:,.!?;"


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def stripped(text: Column) -> Column:
    """Without white space at either end, where white space is Unicode's."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def sentences(text: Column, lines: bool = True) -> Column:
    """Trimmed, non-empty sentences; a line's end ends one too if lines."""
    ends = "。！？!?；;" + ("\n" if lines else "")
    parts = F.transform(F.split(text, f"(?<=[{ends}])"), stripped)
    return F.filter(parts, lambda s: s != "")


def shared_sentences(text: Column, a: Column, b: Column, lines: bool = True) -> Column:
    return F.filter(sentences(text, lines), lambda s: s.contains(a) & s.contains(b))


def snippet(text: Column, a: Column, b: Column, size: int = 160) -> Column:
    """The first sentence with both names, else with either, else the beginning."""
    every = sentences(text)
    both = F.filter(every, lambda s: s.contains(a) & s.contains(b))
    either = F.filter(every, lambda s: s.contains(a) | s.contains(b))
    return F.substring(F.coalesce(F.get(both, F.lit(0)), F.get(either, F.lit(0)), text), 1, size)


def tokens(text: Column) -> Column:
    """Lower-cased tokens: single CJK characters and ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\u4e00-\\u9fff]|[a-zA-Z0-9_]+"), F.lit(0))


def is_noise(name: Column) -> Column:
    trimmed = stripped(F.coalesce(name, F.lit("")))
    return (F.length(trimmed) <= 1) | trimmed.isin(*NOISE_NAMES)


def is_designation(name: Column) -> Column:
    """A name that describes a relation rather than naming someone."""
    return name.contains("的") | ((F.length(name) > 5) & name.rlike("[的之与和跟]"))


def strip_title(name: Column) -> Column:
    """Without the first title suffix that fits and leaves something."""
    cases = [(name.endswith(s) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))) for s in TITLE_SUFFIXES]
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), name)


def normal_surname(name: Column) -> Column:
    cases = [(name.startswith(a), F.concat(F.lit(b), F.substring(name, F.lit(len(a) + 1), F.length(name)))) for a, b in SURNAME_SPELLINGS.items()]
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), name)


def normal_name(name: Column) -> Column:
    return strip_title(normal_surname(name))


def normal_answer(text: Column) -> Column:
    """Lower case, without punctuation and white space."""
    marks = "".join("\\" + c for c in PUNCTUATION)
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"(?U)[{marks}\\s]+", "")


def affirmed(answer: Column, alias: Column, window: int = 4, negations: tuple[str, ...] = NEGATIONS) -> Column:
    """Whether alias occurs in answer at least once without a negation in the characters before."""
    a, n = normal_answer(answer), normal_answer(alias)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.length(n)) == n)
    before = F.transform(starts, lambda i: F.substring(a, F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window))))
    return (F.length(n) > 0) & F.exists(before, lambda p: ~p.rlike("|".join(negations)))


def era_of_book(book: Column) -> Column:
    exact = F.coalesce(*[F.when(book == b, e) for b, e in BOOK_ERA.items()])
    return F.coalesce(exact, *[F.when(book.contains(b), e) for b, e in BOOK_ERA.items()])


def known_era(value: Column) -> Column:
    """An era as it is called: itself, or that of the book that is named; null for neither."""
    eras = tuple(dict.fromkeys(BOOK_ERA.values()))
    said = stripped(F.coalesce(value, F.lit("")))
    return F.when(said.isin(*eras), said).otherwise(era_of_book(said))


def era_scope(question: Column) -> Column:
    """Eras that the longest era keyword of a question names; empty if it has none."""
    ranked = sorted(ERA_KEYWORDS.items(), key=lambda x: -len(x[0]))
    named = [F.when(question.contains(k), F.array(*[F.lit(e) for e in eras])) for k, eras in ranked]
    return F.coalesce(*named, F.array().cast("array<string>"))


def edge_key(src: Column, rel: Column, dst: Column) -> Column:
    return F.concat_ws("|", src, rel, dst)


def without_fence(text: Column) -> Column:
    """An answer's text without the code fence around it."""
    return F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*\n?|\n?```\s*$", "")


def evidence_gate(kind: Column, source: Column, target: Column, evidence: Column, text: Column, strict: tuple[str, ...] = ("PARENT_OF",), kinship: str = KINSHIP) -> tuple[Column, Column]:
    """Reason code for rejecting a relation (null: accepted) and the evidence that is adopted."""
    given = stripped(F.coalesce(evidence, F.lit("")))
    shared = shared_sentences(text, source, target)
    family = F.filter(shared, lambda s: s.rlike(kinship))
    hinted = F.coalesce(*[F.when(kind == t, F.get(_matching(shared, h), F.lit(0))) for t, h in HINTS.items()])
    must = kind.isin(*strict)
    reason = (
        F.when((given != "") & ~without_space(text).contains(without_space(given)), "not_in_text")
        .when((given != "") & must & ~given.rlike(kinship), "no_kinship")
        .when(given != "", F.lit(None))
        .when(F.size(shared) == 0, "no_shared_sentence")
        .when(must & (F.size(family) == 0), "no_kinship_sentence")
    )
    adopted = F.when(given != "", given).when(must, F.get(family, F.lit(0))).otherwise(F.coalesce(hinted, F.get(shared, F.lit(0))))
    return reason, F.when(reason.isNull(), adopted)


def _matching(parts: Column, pattern: str) -> Column:
    return F.filter(parts, lambda s: s.rlike(pattern))
