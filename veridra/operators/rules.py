"""Rules of a class: if a record meets the preconditions it must meet the postconditions, else the
else-conditions. All become columns; the driver only orders them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridra.functions.expressions import Compiler, all_of, any_of
from veridra.functions.library import truthy
from veridra.operators.checks import Check, satisfied
from veridra.plans import resolve
from veridra.plans.model import Conditions, Expr, Rule, Schema


def holds(s: Schema, c: Conditions | None, compiler: Compiler) -> Column:
    """Whether a record meets the conditions; none are always met."""
    if c is None:
        return F.lit(True)
    parts = [_slot_holds(s, name, e, compiler) for name, e in c.slot_conditions.items()]
    parts += [truthy(compiler(x)) for x in c.expression_conditions]
    for name in ("any_of", "all_of", "exactly_one_of", "none_of"):
        if branches := getattr(c, name):
            each = [holds(s, b, compiler) for b in branches]
            n = sum((x.cast("int") for x in each[1:]), each[0].cast("int"))
            parts.append({"any_of": n > 0, "all_of": n == len(each), "exactly_one_of": n == 1, "none_of": n == 0}[name])
    return F.coalesce(all_of(parts), F.lit(False))


def _slot_holds(s: Schema, name: str, e: Expr, compiler: Compiler) -> Column:
    x = compiler.name(name)
    return satisfied(s, x.column, x.kind, e, compiler)


#: Parts of a slot condition, and the codes of issues about them.
PARTS = {"required": "RULE_REQUIRED", "range": "RULE_RANGE", "pattern": "RULE_PATTERN", "equals_string": "RULE_EQUALS", "equals_number": "RULE_EQUALS", "equals_string_in": "RULE_EQUALS", "equals_expression": "RULE_EXPRESSION", "minimum_value": "RULE_MINIMUM", "maximum_value": "RULE_MAXIMUM", "any_of": "RULE_COMBINATION", "all_of": "RULE_COMBINATION", "exactly_one_of": "RULE_COMBINATION", "none_of": "RULE_COMBINATION"}


def failures(s: Schema, c: Conditions, compiler: Compiler) -> list[tuple[str, str, Column]]:
    """slot, code and whether it fails, for each part of the conditions."""
    blank, out = Expr(), []
    for name, e in c.slot_conditions.items():
        for part, code in PARTS.items():
            if getattr(e, part) != getattr(blank, part):
                out.append((name, code, ~_slot_holds(s, name, replace(blank, **{part: getattr(e, part)}), compiler)))
    out += [("", "RULE_EXPRESSION", ~truthy(compiler(x))) for x in c.expression_conditions]
    for name in ("any_of", "all_of", "exactly_one_of", "none_of"):
        if getattr(c, name):
            out.append(("", "RULE_COMBINATION", ~holds(s, Conditions(**{name: getattr(c, name)}), compiler)))
    return out


@dataclass
class CompiledRule:
    rule: Rule
    matched: Column
    checks: list[Check]

    def violated(self) -> Column:
        return F.coalesce(any_of([c.violated for c in self.checks]), F.lit(False))


def compile_rule(s: Schema, r: Rule, compiler: Compiler) -> CompiledRule:
    pre = holds(s, r.preconditions, compiler)
    checks = []
    for c, when in ((r.postconditions, pre), (r.elseconditions, ~pre)):
        for slot, code, failed in failures(s, c, compiler) if c else []:
            checks.append(Check(slot, code, when & F.coalesce(failed, F.lit(True)), f"rule {r.title}: {slot or 'the record'} does not meet its conditions", validator=f"rule:{r.title}", path=f"$.{slot}" if slot else "$"))
    return CompiledRule(r, pre, checks)


def effective_rules(s: Schema, cls: str, overrides: dict[str, dict] | None = None) -> list[Rule]:
    """Rules of the class and of those it inherits from, by falling priority. Each step up costs ten;
    of rules with one title the nearest stays. overrides: by title, what replaces parts of a rule."""
    out: dict[str, Rule] = {}
    distance, level = 0, [cls]
    while level:
        for name in level:
            for i, r in enumerate(s.classes[name].rules):
                title = r.title or r.description or f"{name} {i + 1}"
                out.setdefault(title, replace(r, title=title, priority=r.priority - 10 * distance))
        level = list(dict.fromkeys(p for name in level for p in resolve.parents(s, name)))
        distance += 1
    done = [replace(r, **(overrides or {}).get(t, {})) for t, r in out.items()]
    return sorted((r for r in done if not r.deactivated), key=lambda r: (-r.priority, r.title))


def compile_rules(s: Schema, cls: str, compiler: Compiler, overrides: dict[str, dict] | None = None) -> list[CompiledRule]:
    return [compile_rule(s, r, compiler) for r in effective_rules(s, cls, overrides)]


def first_violated(rules: list[CompiledRule]) -> Column:
    """The title of the first rule that a record violates (fail-fast), NULL if there is none."""
    return F.coalesce(*[F.when(r.violated(), F.lit(r.rule.title)) for r in rules], F.lit(None).cast("string"))


def rule_statistics(df: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """title, matched, skipped and issues of each rule, in one pass."""
    sums = []
    for i, r in enumerate(rules):
        issues = sum((F.coalesce(c.violated, F.lit(False)).cast("long") for c in r.checks), F.lit(0).cast("long"))
        sums += [F.sum(r.matched.cast("long")).alias(f"m{i}"), F.sum(issues).alias(f"i{i}")]
    total = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(r.rule.title).alias("title"), F.coalesce(f"m{i}", F.lit(0)).alias("matched"), (F.col("n") - F.coalesce(f"m{i}", F.lit(0))).alias("skipped"), F.coalesce(f"i{i}", F.lit(0)).alias("issues")) for i, r in enumerate(rules)])
    return total.select(F.explode(rows).alias("r")).select("r.*")
