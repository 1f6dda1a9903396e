"""Error classes and the messages of contract breaches.

In batch plans these are rows, with the class name in ``class``; the exceptions are
raised where a caller asks for strict results, or for faults of the caller's own code.
"""

from __future__ import annotations


class PersistentError(Exception):
    """A retry would fail the same way."""


class TransientError(Exception):
    """A retry may succeed."""


class AssumptionError(PersistentError):
    """The site is not as the scraper takes it to be. The text is the message, then the
    URL, then one line for each item of context."""

    def __init__(self, message: str, url: str = "", context: dict | None = None):
        self.message, self.url, self.context = message, url, dict(context or {})
        lines = [message, f"URL: {url}"]
        if self.context:
            lines += ["Context:"] + [f"  {k}: {v}" for k, v in self.context.items()]
        super().__init__("\n".join(lines))


class StructureError(AssumptionError):
    """A selector matched too few or too many elements."""

    def __init__(self, selector: str, grammar: str, description: str, least: int, most: int | None, found: int, url: str = ""):
        self.selector, self.grammar, self.description = selector, grammar, description
        self.least, self.most, self.found = least, most, found
        context = {"selector": selector, "selector_type": grammar, "expected_min": least, "expected_max": most, "actual_count": found}
        super().__init__(f"HTML structure mismatch for '{description}': expected {expected_count(least, most)}, found {found}", url, context)


class DataFormatError(AssumptionError):
    """A record does not fit its declared schema."""

    def __init__(self, model: str, errors: list[dict], url: str = ""):
        self.model, self.errors = model, errors
        said = ", ".join(f"{e['loc']}: {e['msg']}" for e in errors)
        super().__init__(f"{model}: {said}", url, {"model": model, "error_count": len(errors)})


class IncidentalError(AssumptionError):
    """The captured requests that match a spec are not as many as it says."""


class ConfigError(PersistentError):
    """A fault of the scraper's own code, such as a selector that does not parse."""


class PersistentHTTPError(PersistentError):
    """A status of the persistent class."""


class HTTPAssumptionError(TransientError):
    """An unexpected status that a retry may cure."""


class TimeoutError_(TransientError):
    """No response in time."""


class SpeculationFailure(Exception):
    """A probe found nothing. Neither transient nor persistent: an outcome, not an error row."""


class HaltRun(Exception):
    """Stop the run."""


class SkipRequest(Exception):
    """Leave out this request."""


def expected_count(least: int, most: int | None) -> str:
    if most is None:
        return f"at least {least}"
    return f"exactly {least}" if most == least else f"between {least} and {most}"
