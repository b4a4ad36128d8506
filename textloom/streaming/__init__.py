"""Profiles that keep up with a growing folder of rows. (The batch engine's operators are the reference for results.)"""
