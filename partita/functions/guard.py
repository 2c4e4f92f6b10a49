"""Time limits for single records in Python functions, so that one record can't hold up its task."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable


def within(seconds: float, fn: Callable, *args):
    """(fn(*args), False), or (None, True) if it took over `seconds`. 0 or less: no limit. Limits work in the main thread only, which is where Spark runs Python functions."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        return fn(*args), False

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return fn(*args), False
    except TimeoutError:
        return None, True
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
