"""What stops a run, as against a claim that is merely unverifiable."""


class AttestError(Exception):
    """Base of every refusal."""


class SourceError(AttestError):
    """A table that may not be used: undeclared origin, missing or changed file, no rows."""


class CatalogError(AttestError):
    """A context that contradicts itself."""


class UnitError(AttestError):
    """A conversion that would be a guess."""


class LabelError(AttestError):
    """A rate without its rule or its denominator."""


class BeliefError(AttestError):
    """A claim graph that can't be closed over."""


class JobError(AttestError):
    """A job record that says more than it shows."""


class PublishError(AttestError):
    """An output that can't be written as asked."""
