"""Repositories that tables make: their texts never meet in a shuffle, and what is skipped or stopped early changes no fact."""

import re

from quillgrid.operators import facts
from quillgrid.plans import content

SF = "/root/testdata/sf0.001"


def test_texts_are_not_shuffled(spark):
    """One shuffle by repository, of paths and keys; the scan's window takes the rows as they lie. Texts of all parts were made, dealt and sorted before."""
    plan = content.known(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(repo", plan)) == 1 and "rangepartitioning" not in plan
    exchange = plan.index("Exchange hashpartitioning(repo")
    assert "content" not in plan[exchange:]


def test_block_ends_near_and_far():
    """Ends that a look at the next lines finds, and those behind it, are the same as by all lines."""
    for body in (1, facts.NEXT_LINES - 2, facts.NEXT_LINES - 1, facts.NEXT_LINES, facts.NEXT_LINES + 1, 299, 400):
        for tail in ([], ["x = 1"], ["", "   ", "x = 1"]):
            for indent in ("", "  ", "\t"):
                text = [f"{indent}def f(a):", *[f"{indent}    y = 2"] * body, *tail]
                lines = facts.Lines(text, "python")
                assert lines.end(0, 300, 1) == min(lines.outdented[0], 300, len(text)), (body, tail, indent)
