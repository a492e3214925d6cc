"""Errors of the eager interface. The DataFrame interface returns empty frames instead."""

from __future__ import annotations


class KeelsonError(Exception):
    """Base of all errors of this package."""


class NotFound(KeelsonError):
    """Something asked for is not there."""


class KeyNotFound(NotFound): ...


class BucketNotFound(NotFound): ...


class BucketAlreadyExists(KeelsonError): ...


class RangeScanEmpty(NotFound): ...


class PrefixScanEmpty(NotFound): ...


class PrefixSearchEmpty(NotFound): ...


class ListNotFound(NotFound): ...


class EmptyList(NotFound): ...


class StartOrEnd(KeelsonError): ...


class CountTooLarge(KeelsonError): ...


class SetNotFound(NotFound): ...


class SetMemberNotFound(NotFound): ...


class SortedSetNotFound(NotFound): ...


class SortedSetMemberNotFound(NotFound): ...


class SortedSetEmpty(NotFound): ...


class ValueNotInteger(KeelsonError): ...


class OffsetInvalid(KeelsonError): ...


class StartGreaterThanEnd(KeelsonError): ...


class ArgumentsNotEven(KeelsonError): ...


class BadPattern(KeelsonError): ...


class KeyEmpty(KeelsonError): ...


class KeySeparator(KeelsonError): ...


class ReadOnly(KeelsonError): ...


class TxClosed(KeelsonError): ...


class Locked(KeelsonError): ...


class WriteLimitExceeded(KeelsonError): ...


class NothingToCompact(KeelsonError): ...


class TooLarge(KeelsonError):
    """A key, a value, or both together over the limit of an entry."""


class TooManyTransactions(KeelsonError): ...


class StoreClosed(TxClosed): ...


class CallbackTimeout(KeelsonError): ...


def is_store_closed(e: BaseException) -> bool:
    return isinstance(e, StoreClosed)


def is_too_large(e: BaseException) -> bool:
    return isinstance(e, TooLarge)


def is_key_not_found(e: BaseException) -> bool:
    return isinstance(e, KeyNotFound)


def is_bucket_not_found(e: BaseException) -> bool:
    return isinstance(e, BucketNotFound)


def is_key_empty(e: BaseException) -> bool:
    return isinstance(e, KeyEmpty)


def is_prefix_scan_empty(e: BaseException) -> bool:
    return isinstance(e, PrefixScanEmpty)


def is_prefix_search_empty(e: BaseException) -> bool:
    return isinstance(e, PrefixSearchEmpty)


def is_range_scan_empty(e: BaseException) -> bool:
    return isinstance(e, RangeScanEmpty)
