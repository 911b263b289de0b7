"""Language profiles: what the text metrics look for in one language or script."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptProfile:
    """Fixed values of one language; every metric takes a profile."""

    letters: str  #: regular-expression class of the letters that may end a sentence
    exception_keywords: tuple[str, ...] = ()
    exemplars: tuple[str, ...] = ()
    rules: tuple[tuple[str, str, str, str], ...] = ()  #: (name, kind, pattern, start of the token's tag or ""), in the order of the columns
    ordinals: tuple[tuple[str, int], ...] = ()

    @property
    def rule_names(self) -> list[str]:
        return [name for name, *_ in self.rules]

    def of_kind(self, *kinds: str) -> list[tuple[str, str, str, str]]:
        return [r for r in self.rules if r[1] in kinds]


#: Kinds of rules: a token that starts with the pattern, one that equals it, and a regular expression over collapsed text.
START, EXACT, PHRASE = "start", "exact", "phrase"

# The word lists of the published study.
HANGUL = ScriptProfile(
    letters="가-힣",
    exception_keywords=("다만", "그러나", "예외", "제외", "불구하고"),
    exemplars=(
        "다만 다음 각 호의 어느 하나에 해당하는 경우에는 그러하지 아니하다.",
        "그러나 특별한 사정이 있는 때에는 그러하지 아니하다.",
        "예외적으로 대통령령으로 정하는 경우에는 그러하지 아니하다.",
        "다만 제2항의 경우에는 이를 적용하지 아니한다.",
    ),
    rules=(
        ("적절히", START, "적절", ""),
        ("충분히", START, "충분", ""),
        ("일부", EXACT, "일부", ""),
        ("일정하게", START, "일정", "VA"),
        ("때때로", EXACT, "때때로", ""),
        ("가끔", EXACT, "가끔", ""),
        ("대체로", EXACT, "대체로", ""),
        ("일반적으로", START, "일반적", ""),
        ("보통", EXACT, "보통", ""),
        ("주로", EXACT, "주로", ""),
        ("종종", EXACT, "종종", ""),
        ("간혹", EXACT, "간혹", ""),
        ("드물게", START, "드물", ""),
        ("어느 정도", PHRASE, r"어느\s*정도", ""),
        ("일정 수준", PHRASE, r"일정\s*수준", ""),
        ("수시로", EXACT, "수시로", ""),
        ("정기적으로", START, "정기적", ""),
        ("간헐적으로", START, "간헐적", ""),
        ("주기적으로", START, "주기적", ""),
        ("필요 시", PHRASE, r"필요\s*시(에)?|필요시(에)?", ""),
        ("추후", EXACT, "추후", ""),
        ("향후", EXACT, "향후", ""),
        ("때에 따라", PHRASE, r"때에\s*따라", ""),
        ("합리적으로", START, "합리", ""),
        ("비슷하게", START, "비슷", ""),
        ("제때", PHRASE, r"제때(에)?", ""),
        ("할 수도", PHRASE, r"\b할\s*수도\b", ""),
        ("몇몇", EXACT, "몇몇", ""),
        ("꽤", EXACT, "꽤", ""),
        ("자주", EXACT, "자주", ""),
    ),
    ordinals=(("초선", 1), ("재선", 2), ("삼선", 3), ("사선", 4), ("오선", 5), ("육선", 6), ("칠선", 7), ("팔선", 8), ("구선", 9), ("십선", 10)),
)

#: The driver's corpora are invented prose in Latin script: rules on syllables that occur in it.
LATIN = ScriptProfile(
    letters=r"\p{L}",
    exception_keywords=("but", "aber", "mais", "pero", "thou"),
    rules=(
        ("general", START, "gener", ""),
        ("periodic", START, "period", ""),
        ("onward", START, "onw", ""),
        ("thing", START, "thing", ""),
        ("heed", START, "heed", "VA"),
        ("often", EXACT, "often", ""),
        ("some", EXACT, "some", ""),
        ("from", EXACT, "from", ""),
        ("with", EXACT, "with", ""),
        ("pour", EXACT, "pour", ""),
        ("para", EXACT, "para", ""),
        ("nicht", EXACT, "nicht", ""),
        ("of the", PHRASE, r"of\s*the", ""),
        ("in the", PHRASE, r"in\s*the", ""),
        ("de la", PHRASE, r"de\s*la", ""),
        ("und der", PHRASE, r"und\s*der", ""),
    ),
    ordinals=(("first", 1), ("second", 2), ("third", 3)),
)
