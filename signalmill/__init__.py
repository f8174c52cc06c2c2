"""signalmill: trend analytics over social-signal data as DataFrame-to-DataFrame functions."""
