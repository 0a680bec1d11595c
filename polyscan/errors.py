"""Errors of the engine."""


class PolyscanError(Exception):
    """Base of all errors raised here."""


class ConfigError(PolyscanError):
    """The configuration can't be read or is not valid."""


class UnknownTable(PolyscanError):
    """A name that no source or provider defines."""


class UnsupportedSource(PolyscanError):
    """A source or file kind that can't be read here."""


class SourceError(PolyscanError):
    """A source failed while it was read."""


class HttpStatusError(SourceError):
    """The server answered with an error status."""

    def __init__(self, status: int, url: str):
        super().__init__(f"HTTP status {status} from {url}")
        self.status, self.url = status, url

    def __reduce__(self):
        return (type(self), (self.status, self.url))


class RateLimited(HttpStatusError):
    """Status 429 after the last attempt."""


class RequestTimeout(SourceError):
    """No answer within timeout_ms after the last attempt."""


class DecodeError(SourceError):
    """An answer or a line that isn't what its format says."""


class PageLimitReached(SourceError):
    """max_pages pages were read and the server has more."""
