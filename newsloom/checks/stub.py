"""A stand-in for the model: answers a prompt with excerpts of the text it holds."""

import json


def _between(prompt: str, tag: str) -> str:
    start, end = prompt.find(f"<{tag}>"), prompt.rfind(f"</{tag}>")
    return prompt[start + len(tag) + 2 : end]


def _first(text: str, n: int) -> str:
    words = text.split()
    return " ".join(words[:n]) + ("..." if len(words) > n else "")


def _content(prompt: str) -> str:
    content = _between(prompt, "content")
    if not content.strip():
        raise ValueError("empty text")
    return content


def summarize(prompt: str) -> str:
    content = _content(prompt)
    return json.dumps({f"summary_{n}": _first(content, n) for n in (30, 111, 250)})


def translate(prompt: str) -> str:
    names = ("title", "summary_30", "summary_111", "summary_250")
    return json.dumps({name: "~" + _between(prompt, name) for name in names})


def combined(prompt: str) -> str:
    content, title = _content(prompt), _between(prompt, "title")
    answer = {"english_title": title}
    answer |= {f"english_{n}": _first(content, n) for n in (30, 111, 250)}
    answer |= {name.replace("english", "target"): "~" + text for name, text in answer.items()}
    return "```json\n" + json.dumps(answer, ensure_ascii=False) + "\n```"


def summarize_or_translate(prompt: str) -> str:
    return translate(prompt) if "<summary_30>" in prompt else summarize(prompt)


def terse(prompt: str) -> str:
    """Refuses texts of fewer than ten words."""
    if len(_content(prompt).split()) < 10:
        raise ValueError("text too short")
    return summarize(prompt)


def translate_longer(prompt: str) -> str:
    """Refuses briefs whose short summary has fewer than thirty words."""
    if len(_between(prompt, "summary_30").split()) < 30:
        raise ValueError("text too short")
    return translate(prompt)
