"""In-memory clients: deterministic stand-ins for a provider, built in each task."""

from __future__ import annotations

from gradeloom.operators.inference import RateLimited, TransportError


def _prompt(body: dict) -> str:
    """Text of the single user message, in any of the three request shapes."""
    if "contents" in body:
        return body["contents"][0]["parts"][0]["text"]
    content = body["messages"][0]["content"]
    return content if isinstance(content, str) else content[0]["text"]


def _reply(provider: str, text: str, prompt: str) -> dict:
    if provider == "gemini":
        return {
            "candidates": [{"content": {"parts": [{"text": text}]}, "finishReason": "STOP"}],
            "usageMetadata": {"promptTokenCount": len(prompt), "candidatesTokenCount": len(text),
                              "totalTokenCount": len(prompt) + len(text)},
        }
    if provider == "ollama":
        return {"message": {"content": text}, "done_reason": "stop",
                "prompt_eval_count": len(prompt), "eval_count": len(text)}
    return {"choices": [{"message": {"content": text}}],
            "usage": {"prompt_tokens": len(prompt), "completion_tokens": len(text),
                      "total_tokens": len(prompt) + len(text)}}


def echo_client():
    """Answers with the prompt and an exclamation mark.

    Prompts of a length divisible by 5 are rate-limited once, by 7 lose one
    connection, by 11 are refused.
    """
    seen: dict[str, int] = {}

    def call(body: dict, row: dict) -> dict:
        prompt = _prompt(body)
        key = f"{row['provider']}/{row['model']}/{row['item_id']}"
        seen[key] = seen.get(key, 0) + 1
        if len(prompt) % 11 == 0:
            raise RuntimeError(f'API error (403 on model "{row["model"]}")')
        if seen[key] == 1 and len(prompt) % 5 == 0:
            raise RateLimited(retry_after="0")
        if seen[key] == 1 and len(prompt) % 7 == 0:
            raise TransportError("connection reset")
        return _reply(row["provider"], prompt + "!", prompt)

    return call


def verdict_client():
    """A judge whose score depends on the length of its prompt; one in five answers prose."""

    def call(body: dict, row: dict) -> dict:
        prompt = _prompt(body)
        score = len(prompt) % 5 + 1
        if score == 5:
            text = "This answer is fine."
        else:
            text = f'```json\n{{"score": {score}, "reasoning": "length {len(prompt)}"}}\n```'
        if len(prompt) % 13 == 0:
            raise RuntimeError("API error (500)")
        return _reply(row["provider"], text, prompt)

    return call


def plain_client():
    """Answers with the prompt and an exclamation mark."""
    return lambda body, row: _reply(row["provider"], _prompt(body) + "!", _prompt(body))


def refusing_client():
    """The same, but prompts of a length divisible by 3 fail."""

    def call(body: dict, row: dict) -> dict:
        if len(_prompt(body)) % 3 == 0:
            raise RuntimeError("API error (500)")
        return plain_client()(body, row)

    return call


def probed_client():
    """Refuses the key of one provider; another one is out of order."""

    def call(body: dict, row: dict) -> dict:
        failing = {"nvidia": "API error (403)", "gemini": "API error (500)"}
        if row["provider"] in failing:
            raise RuntimeError(failing[row["provider"]])
        return _reply(row["provider"], "pong", "ping")

    return call


def customer_lister():
    """Lists customers by number, 100 a page, those of three of four numbers; one provider fails on its second page."""
    tried: set = set()

    def ask(provider: str, token: str | None):
        start = int(token or 0)
        if start == 100 and provider == "nvidia":
            raise RuntimeError("API error (503)")
        if provider not in tried:
            tried.add(provider)
            raise RateLimited(retry_after="0")
        names = [f"Customer#{n:09d}" for n in range(start, start + 100) if n % 4]
        if provider == "ollama":
            reply = {"models": [{"name": x, "capabilities": ["vision"] if int(x[-1]) % 2 else []} for x in names]}
        elif provider == "gemini":
            reply = {"models": [{"name": f"models/{x}", "supportedGenerationMethods": ["generateContent"]} for x in names]}
        else:
            reply = {"data": [{"id": x} for x in names]}
        return reply, str(start + 100) if start < 900 else None

    return ask
