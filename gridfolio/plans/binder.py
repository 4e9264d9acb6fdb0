"""Binding of the words of a question to columns. Headers are few, so this runs on the driver."""

from __future__ import annotations

import re


def label(text: str | None) -> str:
    """Label normal form, the same as the Column function of that name."""
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip()


def by_name(target: str | None, headers: list[str]) -> str | None:
    """The header that fits ``target`` best: equal labels, else the longest containment either way, else the most shared words.

    Ties go to the header that comes first.
    """
    want = label(target)
    labels = [label(h) for h in headers]
    if not want:
        return None
    scores = (
        [int(h == want) for h in labels],
        [min(len(h), len(want)) if h and (h in want or want in h) else 0 for h in labels],
        [len(set(h.split()) & set(want.split())) for h in labels],
    )
    for score in scores:
        if max(score, default=0) > 0:
            return headers[score.index(max(score))]
    return None


def by_mention(question: str, headers: list[str]) -> str | None:
    """The longest header that a question contains, else the first match of its runs of four to one words."""
    text = label(question)
    labels = [label(h) for h in headers]
    inside = [len(h) if h and h in text else 0 for h in labels]
    if max(inside, default=0):
        return headers[inside.index(max(inside))]
    words = re.findall(r"[A-Za-z0-9][A-Za-z0-9-]*", question)
    runs = (" ".join(words[i : i + n]) for n in range(min(4, len(words)), 0, -1) for i in range(len(words) - n + 1))
    return next((found for run in runs if (found := by_name(run, headers))), None)
