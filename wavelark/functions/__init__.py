"""Parameter checks, time axes, tapers and time-frequency transforms."""
