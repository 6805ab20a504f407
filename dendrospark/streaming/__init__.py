"""Streaming use of the model surface.

The reference is batch only.  The one operator that is meaningful on an
unbounded input is D6 (assign each arriving point to its nearest center):
it is a stateless projection after a stream-static broadcast join, so the
batch ``predict`` plan runs unchanged under Structured Streaming.
"""

from .assign import predict_stream

__all__ = ["predict_stream"]
