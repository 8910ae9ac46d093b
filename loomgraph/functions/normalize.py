"""Entity, co-list and predicate normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import bind, is_blank, strip

# fixed values: endings that mark a whole sentence, in the place of an entity
SENTENCE_ENDINGS = [
    "해요", "했어요", "해야", "합니다", "했습니다", "한다", "했다", "하였다", "였다", "이다", "입니다", "이에요", "예요", "에요",
    "하기로 함", "하기로 했", "하지 않아요", "않는다", "않았다", "된다", "됐다", "되었다", "됩니다", "됐습니다",
    "함", "했음", "였음", "됨", "임", "인가요", "할까요", "나요", "을까요", "ㄹ까요",
]
# fixed values: spelling variants (lower case) and the name they stand for; the names of an
# organisation are its own data and come in through EntityRules(aliases=...)
ALIASES = {
    "팀 전체": "팀",
    "우리 팀": "팀",
    "전체 팀": "팀",
}
# fixed values: words that end like an honorific but are nouns of their own
NOT_HONORIFIC = ["하나님", "하느님", "선생님", "부처님", "임님", "손님", "스승님"]
# fixed values: patterns of a name with nickname, a co-list, its separators, a legal-form suffix
NICKNAME = r"^([가-힣]{2,4})\([가-힣A-Za-z]{1,6}\)$"
CO_LISTED = r"^[^,·・]{1,20}([,·・]\s*[^,·・]{1,20}){1,2}$"
CO_SEPARATOR = "[,·・]"
LEGAL_SUFFIX = r"(?i)^(inc|ltd|llc|co|corp|주식회사|㈜)\.?$"
# fixed values: canonical predicates and the fragments that lead to them, first match wins
PREDICATES = {
    "결정했다": ["결정", "정했다", "합의", "확정"],
    "포함한다": ["포함", "구성", "가진다", "가지고", "보유", "이루어", "속한다", "담고", "구비"],
    "필요로 한다": ["필요", "요구", "필수", "요한다", "요청"],
    "유발한다": ["유발", "발생", "초래", "야기", "일으킨", "원인", "영향", "기여", "이어진"],
    "제한한다": ["제한", "방지", "차단", "막는다", "금지", "줄인", "축소"],
    "해결한다": ["해결", "개선", "완화", "보완", "향상", "강화"],
    "활용한다": ["활용", "사용", "수행", "진행", "이용", "적용", "실행"],
    "제공한다": ["제공", "지원", "확보", "부여", "공급", "가능하게"],
    "고려한다": ["고려", "검토", "감안", "고민"],
    "목표로 한다": ["목표", "지향", "추진", "추구", "계획", "준비"],
    "선호한다": ["선호", "원한다", "희망"],
    "의존한다": ["의존", "종속", "기반"],
    "담당한다": ["담당", "책임", "맡"],
    "공유한다": ["공유", "전달", "보고", "안내"],
    "확인한다": ["확인", "참고", "점검", "검증"],
    "운영한다": ["운영", "관리", "유지", "처리"],
    "협력한다": ["협력", "조율", "연계", "협업", "소통", "참여"],
    "제약된다": ["어렵", "불가능", "부족", "겪는", "제외", "미흡", "한계"],
    "속성이다": ["중요", "특징", "적합", "부합", "해당", "특성"],
}


@dataclass(frozen=True)
class EntityRules:
    """Rule tables; every field can be replaced for another language."""

    endings: Sequence[str] = tuple(SENTENCE_ENDINGS)
    aliases: Mapping[str, str] = field(default_factory=lambda: dict(ALIASES))
    honorific: str = "님"
    not_honorific: Sequence[str] = tuple(NOT_HONORIFIC)
    max_length: int = 40
    predicates: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(PREDICATES))
    max_predicate: int = 30


def collapse(col: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def normalize_entity(raw: Column, rules: EntityRules = EntityRules()) -> Column:
    """Normalised entity, or null when the text is no noun phrase."""
    sentence = "(" + "|".join(rules.endings) + r")[.!?]?\s*$"

    def without_honorific(bare: Column) -> Column:
        polite = bare.endswith(rules.honorific) & (F.length(bare) >= 3) & ~bare.isin(*rules.not_honorific)
        return F.when(polite, F.substr(bare, F.lit(1), F.length(bare) - len(rules.honorific))).otherwise(bare)

    def without_nickname(name: Column) -> Column:
        return F.regexp_replace(name, NICKNAME, "$1")

    def aliased(name: Column) -> Column:
        if not rules.aliases:
            return name
        table = F.create_map(*[F.lit(x) for pair in rules.aliases.items() for x in pair])
        return F.coalesce(F.try_element_at(table, F.lower(name)), name)

    def accepted(name: Column) -> Column:
        return F.when(~is_blank(name) & (F.length(name) <= rules.max_length), name)

    def phrase(value: Column) -> Column:
        bare = F.regexp_replace(value, r"(\s*[.。])+$", "")
        steps = bind(bare, lambda b: bind(without_honorific(b), lambda n: bind(aliased(without_nickname(n)), accepted)))
        return F.when(~value.rlike(sentence) & (value != ""), steps)

    return bind(collapse(raw), phrase)


def split_colisted(raw: Column, rules: EntityRules = EntityRules()) -> Column:
    """Array of normalised entities of a text that may list two or three of them."""
    def present(items: Column) -> Column:
        return F.filter(items, lambda e: e.isNotNull())

    def several(value: Column) -> Column:
        parts = F.transform(F.split(value, CO_SEPARATOR), strip)
        names = F.array_distinct(present(F.transform(parts, lambda p: normalize_entity(p, rules))))
        legal = F.exists(parts, lambda p: p.rlike(LEGAL_SUFFIX))
        return F.when(value.rlike(CO_LISTED) & ~legal, names)

    def entities(value: Column) -> Column:
        return bind(
            several(value),
            lambda many: F.when(F.size(many) > 0, many).otherwise(present(F.array(normalize_entity(value, rules)))),
        )

    return bind(strip(raw), entities)


def canonical_predicate(raw: Column, rules: EntityRules = EntityRules()) -> Column:
    """Canonical relation, the text itself when no rule matches, null when blank or too long."""
    def canon(value: Column) -> Column:
        out = None
        for name, needles in rules.predicates.items():
            hit = value.rlike("|".join(needles))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        out = value if out is None else out.otherwise(value)
        return F.when((value != "") & (F.length(value) <= rules.max_predicate), out)

    return bind(collapse(raw), canon)
