"""evenkeel.plans"""
