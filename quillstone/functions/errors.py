"""Layered errors: the layer that refuses a request decides its status."""

STATUS = {0: 503, 1: 409, 2: 500, 3: 403, 4: 400}


class Refused(Exception):
    """A refusal with its layer (0 capacity, 1 identity, 2 integrity, 3 authority, 4 shape), reason and context."""

    def __init__(self, layer: int, reason: str, status: int | None = None, **context):
        super().__init__(f"L{layer} {reason} {context or ''}".strip())
        self.layer, self.reason, self.context = layer, reason, context
        self.status = STATUS[layer] if status is None else status


class BadRequest(Refused):
    """A plain 400 without a layer's envelope."""

    def __init__(self, reason: str, **context):
        super().__init__(4, reason, 400, **context)


class NotFound(Refused):
    def __init__(self, reason: str = "not-found", **context):
        super().__init__(4, reason, 404, **context)
