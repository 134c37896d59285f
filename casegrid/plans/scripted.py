"""A deterministic provider for exercising the model path end to end.

It answers from the prompt alone.  For extraction, the fault it injects is
chosen by ``len(document text) % 5``:

    0  valid case JSON on the first call
    1  invalid JSON on the first attempt, valid JSON on the repair attempt
    2  HTTP 503 on the first transport try, valid JSON on the second
    3  HTTP 401 (not transient): the row fails, no retry
    4  a category outside the enum on every attempt: validation failure

Valid JSON has ``is_complaint`` false when the text mentions "jailbreak",
a lax boolean word for ``escalation_required``, an integer for
``supporting_document_available`` and no ``overall_case_status`` (so it
defaults to ``unknown``).  The issue is the whole document text.  The
summary omits a required heading when the case JSON mentions "kettle".  Token usage is reported per response, with no
total for drafts.
"""

from __future__ import annotations

import hashlib
import json

from casegrid.functions.drafts import DOC_CLOSE, DOC_OPEN, REPAIR_LINE
from casegrid.operators.infer import ProviderError, Response


def _document(prompt: str) -> str:
    # The first mark ends the rules; the last one ends the text.
    start = prompt.index(DOC_OPEN + "\n") + len(DOC_OPEN) + 1
    end = prompt.rindex("\n" + DOC_CLOSE)
    return prompt[start:end]


class ScriptedProvider:
    model_name = "scripted-1"

    def __init__(self) -> None:
        self._seen: set[bytes] = set()  # digests of prompts that failed once

    def _usage(self, prompt: str, content: str, with_total: bool) -> dict:
        p, c = len(prompt) // 4, len(content) // 4
        return {"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c if with_total else 0}

    def complete(self, task: str, prompt: str) -> Response:
        if task == "extract":
            doc = _document(prompt)
            repair = REPAIR_LINE in prompt[:prompt.index(DOC_OPEN + "\n")]
            k = len(doc) % 5
            if k == 3:
                raise ProviderError("unauthorized", status=401)
            if k == 2 and (mark := hashlib.blake2b(prompt.encode(), digest_size=16).digest()) not in self._seen:
                self._seen.add(mark)
                raise ProviderError("service unavailable", status=503)
            if k == 1 and not repair:
                content = "not json {"
            else:
                content = json.dumps({
                    "customer_name": None,
                    "email": None,
                    "phone_number": None,
                    "complaint_category": "furniture" if k == 4 else "other",
                    "issue_description": doc,
                    "resolution_provided": None,
                    "is_complaint": "jailbreak" not in doc.lower(),
                    "escalation_required": "yes",
                    "supporting_document_available": 0,
                })
            return Response(content, self._usage(prompt, content, True))
        if task == "email":
            content = "# Subject: About your case\n\nHello,\n\nWe have your case and are reviewing it.\n"
            return Response(content, self._usage(prompt, content, False))
        if task == "summary":
            heads = ["## Overview", "## Issue", "## Action", "## Status"]
            if "kettle" not in prompt.lower():
                heads.append("## Next action")
            content = "# Case summary\n\n" + "\n\n".join(h + "\nx" for h in heads) + "\n"
            return Response(content, self._usage(prompt, content, False))
        raise ValueError(f"unknown task {task}")


def scripted_factory() -> ScriptedProvider:
    return ScriptedProvider()
