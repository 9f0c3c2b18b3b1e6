"""Errors of the entity store."""


class StoreError(Exception):
    """Base of all."""


class EntityAlreadyExists(StoreError):
    def __init__(self, ids):
        self.ids = sorted(ids) if not isinstance(ids, int) else [ids]
        super().__init__(f"entity already exists: {', '.join(map(str, self.ids))}")


class EntityNotFound(StoreError):
    def __init__(self, ids):
        self.ids = sorted(ids) if not isinstance(ids, int) else [ids]
        super().__init__(f"entity not found: {', '.join(map(str, self.ids))}")


class InvalidFormat(StoreError):
    pass


class UnsupportedVersion(StoreError):
    pass


class StorageLimit(StoreError):
    pass


class InvalidInput(StoreError):
    pass


class LeftDatabaseMissing(StoreError):
    pass


class RightDatabaseMissing(StoreError):
    pass


class OutputInputCollision(StoreError):
    pass


class OutputExists(StoreError):
    pass


class InvalidOutputPath(StoreError):
    pass
