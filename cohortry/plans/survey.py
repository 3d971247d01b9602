"""The survey's own rules, scores, leakage lists, report names and text cards, ready for the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators import clean, features
from ..operators.score import Centered, ConditionalImpact, Linear, Mean, Rule, Speed, StratumRule, StratumScale
from .. import presets as p

RULES = tuple(Rule(*r) for r in p.DOMAIN_RULES)
STRATA = (StratumRule("locomotion", p.GRIP_COLUMNS, p.SEX, p.GRIP_CUTOFFS),)


def _sense(impaired: str, screen: str, impact: str) -> Mean:
    return Mean(((Linear(impaired, -1.0, 1.0, clipped=False), 0.45), (Linear(screen, 1.0, clipped=False), 0.35),
                 (ConditionalImpact(impaired, impact), 0.20)))


#: fixed values: the transforms and weights of the five continuous scores
SCORES = {
    "cognition": Linear("认知-总分", 1 / 30),
    "psychological": Mean(((Linear("心理-总分", -1 / 15, 1.0), 0.85),
                           (Linear("是否焦虑抑郁症", -1.0, 1.0, clipped=False), 0.15))),
    "vitality": Mean(((Linear("活力-总分", 1 / 14), 0.55), (Linear("活力-营养描述结果", 1 / 2), 0.10),
                      (Centered("活力-BMI值", 22.0, 10.0), 0.20), (Linear("小腿围", 1 / 8, -31 / 8), 0.15))),
    "locomotion": Mean(((Linear("运动-总分", 1 / 12), 0.45), (Linear("运动是否完成编码", 1 / 2), 0.10),
                        (Linear("步态异常-编码", -1.0, 1.0), 0.15),
                        (Speed("运动-4米行走时间：日常行走速度走完4米-平均完成时间", 4.0, 0.4, 0.8), 0.15),
                        (StratumScale(p.GRIP_COLUMNS, p.SEX, 1, (28.0, 40.0), (18.0, 28.0)), 0.15))),
    "sensory": Mean(((_sense("听力障碍", "感知-听力", "听力障碍是否影响日常"), 0.5),
                     (_sense("视力障碍", "感知-视力", "视力障碍是否影响日常"), 0.5))),
}


def clipped_counts(df: DataFrame) -> DataFrame:
    """The counts of diseases, drugs and visits clipped to their own 1 % and 99 % quantiles."""
    return clean.winsorize(df, [c for c in p.WINSORIZED if c in df.columns])


def without_inputs(df: DataFrame, keep: Sequence[str] = (), functional: bool = False) -> DataFrame:
    """Without the columns that the scores are made of, and, if ``functional``, without anything named like a function test."""
    left = df.drop(*[c for c in p.LEAKAGE_FIELDS if c not in keep])
    return clean.drop_by_pattern(left, p.FUNCTIONAL_PATTERNS, keep) if functional else left


def report(df: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """Scores, summary and outcomes under their report names."""
    return clean.rename_alias(df, p.SCORE_ALIAS | p.SUMMARY_ALIAS | p.EXTERNAL_ALIAS, first)


def card(df: DataFrame, id_col: str, out: str = "text_card") -> DataFrame:
    """A text per person: the fields that are present, by section."""
    have = {name: [(c, col(c).cast("string")) for c in fields if c in df.columns] for name, fields in p.CARD_SECTIONS.items()}
    lead = F.concat(F.lit("Person "), col(id_col).cast("string"), F.lit("."))
    return features.text_card(df, lead, {name: fields for name, fields in have.items() if fields}, out=out)
