"""DataFrame operators on integers, chunks of them, masks and selector words."""
