"""Error codes and the exception that carries them."""

from __future__ import annotations

from enum import IntEnum


class Code(IntEnum):
    # Codes that clients rely on.
    SUCCESS = 0
    INTERNAL_ERROR = 1
    UNKNOWN_ERROR = 2
    AUTHENTICATION_FAILED = 3
    RECOVER = 4
    TIMEOUT = 5
    PARAM_ERROR = 6
    CONFIG_ERROR = 7
    CANCELED = 8
    PARTITION_EXIST = 140
    PARTITION_NOT_EXIST = 141
    USER_NOT_EXIST = 180
    USER_EXIST = 181
    ROLE_NOT_EXIST = 190
    ROLE_EXIST = 191
    DB_NOT_EXIST = 200
    DB_EXIST = 201
    DB_NOT_EMPTY = 202
    SPACE_EXIST = 220
    SPACE_NOT_EXIST = 221
    ALIAS_NOT_EXIST = 240
    ALIAS_EXIST = 241
    DOCUMENT_NOT_EXIST = 260
    PRIMARY_KEY_IS_INVALID = 261
    FILTER_OPERATOR_TYPE_ERR = 300
    FILTER_CONDITION_OPERATOR_TYPE_ERR = 301
    UPSERT_INVALID_PARAMS = 400
    DELETE_INVALID_PARAMS_SHOULD_NOT_HAVE_VECTOR_FIELD = 422
    DELETE_INVALID_PARAMS_LENGTH_OF_DOCUMENT_IDS_BEYOND_500 = 424
    DELETE_INVALID_PARAMS_SHOULD_HAVE_ONE_OF_DOCUMENT_IDS_OR_FILTER = 425
    QUERY_INVALID_PARAMS_LENGTH_OF_DOCUMENT_IDS_BEYOND_500 = 441
    QUERY_INVALID_PARAMS_SHOULD_HAVE_ONE_OF_DOCUMENT_IDS_OR_FILTER = 442
    QUERY_INVALID_PARAMS_SHOULD_NOT_HAVE_VECTOR_FIELD = 443
    QUERY_INVALID_PARAMS_BOTH_DOCUMENT_IDS_AND_FILTER = 444
    SEARCH_INVALID_PARAMS_SHOULD_HAVE_VECTOR_FIELD = 460
    SEARCH_ENGINE_ERR = 461
    FORCE_MERGE_BUILD_INDEX_ERR = 500


class EngineError(Exception):
    def __init__(self, code: Code, msg: str):
        super().__init__(f"{code.name} ({int(code)}): {msg}")
        self.code, self.msg = code, msg


def param(msg: str) -> EngineError:
    return EngineError(Code.PARAM_ERROR, msg)
