"""Jobs that are run by themselves: each has a function that takes a session, a command line and a small config file."""
