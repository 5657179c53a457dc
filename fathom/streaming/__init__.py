"""Structured Streaming entry points for the stateless operators.

The original tool works on one finite file per request and has no stream, window or state;
the only thing streamed here is the deny-list screen, which is a pure per-row projection and
therefore runs unchanged on a stream of incoming files.
"""

from fathom.streaming.scan import screen_text_stream

__all__ = ["screen_text_stream"]
