"""Prompt text for the seven analysis tasks.

The wording is our own. Each prompt asks for the same findings as the service:
three or four praised features, the top three pain points, one improvement, a
company profile of four fields, and up to two recommendations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

PRODUCT_TASKS = ("praised_features", "pain_points", "improvement")
COMPANY_TASKS = ("company_profile", "strengths", "challenges", "strategy")

_PRAISE = (
    "Read the customer reviews below. Name the 3 or 4 features customers praise most often. "
    "Report good findings only. For each give a name, the reason and one customer quote.\n"
    "Reviews:\n{reviews}"
)
_PAIN = (
    "Read the customer reviews below. Name the 3 problems that trouble customers most. "
    "For each give a name, its effect and one customer quote.\n"
    "Reviews:\n{reviews}"
)

TEMPLATES = {
    "praised_features": _PRAISE + "\nDo not mention review numbers.",
    "pain_points": _PAIN + "\nDo not mention review numbers.",
    "improvement": (
        "Propose the one change that would help {title} most.\n"
        "Features today: {features}\nFindings so far:\n{context}\n"
        "Cover the change, the problems it solves, the gain, the effort and the priority."
    ),
    "company_profile": (
        "Describe {company} from common knowledge in four short fields: business type, "
        "core offerings, customer base, market presence."
    ),
    "strengths": "Company: {company}\nKnown of it:\n{context}\n" + _PRAISE,
    "challenges": "Company: {company}\nKnown of it:\n{context}\n" + _PAIN,
    "strategy": (
        "Recommend at most two improvements for {company}.\nFindings so far:\n{context}\n"
        "For each give the steps to take and the outcome to expect."
    ),
}

# Which earlier tasks a task reads, in this order, and which tasks may run together.
CONTEXT_TASKS = {
    "improvement": ("pain_points", "praised_features"),
    "strengths": ("company_profile",),
    "challenges": ("company_profile",),
    "strategy": ("company_profile", "strengths", "challenges"),
}
PRODUCT_STAGES = (("praised_features", "pain_points"), ("improvement",))
COMPANY_STAGES = (("company_profile",), ("strengths", "challenges"), ("strategy",))

# The models in use and the tasks that get the large one.
SMALL_MODEL, LARGE_MODEL = "gpt-4o-mini", "gpt-4o"
LARGE_MODEL_TASKS = ("improvement", "strategy")
MISSING = "Not available"


def template_parts(task: str) -> list[tuple[str, bool]]:
    """Split a template into (text, is_field) pieces, in order."""
    pieces = re.split(r"\{(\w+)\}", TEMPLATES[task])
    return [(p, i % 2 == 1) for i, p in enumerate(pieces) if p]


def build_prompt(task: str, **fields: Column) -> Column:
    """Fill a template; a field without a value reads ``Not available``."""
    return F.concat(
        *(
            F.coalesce(fields[text].cast("string"), F.lit(MISSING)) if is_field else F.lit(text)
            for text, is_field in template_parts(task)
        )
    )


def route_model(task: Column) -> Column:
    """The large model for the two tasks that weigh other findings, else the small one."""
    return F.when(task.isin(*LARGE_MODEL_TASKS), LARGE_MODEL).otherwise(SMALL_MODEL)
