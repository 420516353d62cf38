"""Questions answered from a corpus: retrieval, citations, prompt, and an answer.

``generate`` is any callable from messages to text; without one, or when it fails, the
answer is extracted from the contexts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tomewright.functions.text import py_truncate
from tomewright.operators import nlp

HISTORY_READ, HISTORY_USED, HISTORY_CHARS = 20, 6, 4000


def messages(question: str, contexts: list[dict], history: list[dict] | None = None) -> list[dict]:
    """Numbered context blocks and the last of the oldest turns, then the question."""
    blocks = [f"[{i}] {c.get('title') or ''}\n{c['text']}" for i, c in enumerate(contexts, 1)]
    past = (history or [])[:HISTORY_READ][-HISTORY_USED:]
    turns = [{"role": h["role"], "content": h["text"][:HISTORY_CHARS]} for h in past]
    return [{"role": "system", "content": "\n\n".join(blocks)}, *turns, {"role": "user", "content": question}]


def citations(contexts: list[dict], width: int = 260) -> list[dict]:
    return [
        {"index": i, "id": c["id"], "title": c.get("title") or "", "snippet": py_truncate(c["text"] or "", width)}
        for i, c in enumerate(contexts, 1)
    ]


def ask(
    question: str,
    contexts: DataFrame,
    history: list[dict] | None = None,
    generate: Callable[[list[dict]], str] | None = None,
    general: bool = False,
) -> dict:
    """{answer, citations, confidence, source}; ``contexts`` (id, title, text, score) is a retrieval's top k.

    Without contexts the answer is empty, unless ``general`` lets ``generate`` answer alone.
    """
    found = [r.asDict() for r in contexts.collect()]  # top_k rows
    found.sort(key=lambda c: (-(c.get("score") or 0), c["id"]))
    if generate is not None and (found or general):
        try:
            text = generate(messages(question, found, history))
            if text:
                return {"answer": text, "citations": citations(found), "confidence": None, "source": "generated"}
        except Exception:
            pass  # the local answer follows
    local = nlp.answer(question, found)
    return {
        "answer": " ".join(local["sentences"]),
        "citations": [c for c in citations(found) if c["id"] in local["citations"]],
        "confidence": local["confidence"],
        "source": "extracted" if found else "none",
    }
