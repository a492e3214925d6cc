"""Where data lives: the shared folder, the operation log and its commits."""
