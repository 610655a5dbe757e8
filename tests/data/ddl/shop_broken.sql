mysql: [Warning] Using a password on the command line interface can be insecure.
ERROR 1146: no such table
