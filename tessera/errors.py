"""Errors, and the exit codes that a command would give."""


class TesseraError(RuntimeError):
    """A request that can't be carried out."""

    code = 1


class SelectionError(TesseraError):
    """Names or selectors that match nothing, or too much."""

    code = 2


class FormatError(TesseraError):
    """Bytes that aren't what their format says."""


class Retryable(TesseraError):
    """A failure that another attempt may not have."""


def exit_code(error: BaseException | None) -> int:
    if error is None:
        return 0
    if isinstance(error, KeyboardInterrupt):
        return 130
    return getattr(error, "code", 1)
