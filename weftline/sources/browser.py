"""Pages as a browser shows them: a fetcher for targets that scripts fill.

Needs Playwright with Chromium, which is no dependency of this package: without it the
fetcher says so when it is called.  One browser serves all calls of a fetcher; on a
cluster every task that fetches has its own.
"""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable

from weftline.sources.web import USER_AGENT, Fetched

#: Kinds of request that no extraction needs.
SKIPPED = frozenset({"image", "media", "font"})


class BrowserMissing(RuntimeError):
    pass


def available() -> bool:
    return importlib.util.find_spec("playwright") is not None


def _launch():
    if not available():
        raise BrowserMissing("rendering needs playwright and chromium, which are not installed")
    from playwright.sync_api import sync_playwright

    return sync_playwright().start().chromium.launch()


def browser_fetch(launch: Callable = _launch, wait_for: str | None = None, timeout: float = 30.0) -> Callable[..., Fetched]:
    """A fetcher; ``wait_for`` names a selector that must be there before the page counts as loaded."""
    held: list = []

    def fetch(url: str, headers: dict[str, str] | None = None) -> Fetched:
        if not held:
            held.append(launch())
        began = time.monotonic()
        context = held[0].new_context(user_agent=USER_AGENT, extra_http_headers=headers or {})
        try:
            page = context.new_page()
            page.route("**/*", lambda route: route.abort() if route.request.resource_type in SKIPPED else route.continue_())
            answer = page.goto(url, timeout=1000 * timeout, wait_until="domcontentloaded" if wait_for else "networkidle")
            if wait_for:
                page.wait_for_selector(wait_for, timeout=1000 * timeout)
            return Fetched(answer.status if answer else 0, page.url, page.content(), int(1000 * (time.monotonic() - began)))
        except BrowserMissing:
            raise
        except Exception as e:  # whatever a browser stumbles over is a failed fetch
            return Fetched(0, url, f"<!-- {e} -->", int(1000 * (time.monotonic() - began)))
        finally:
            context.close()

    return fetch
